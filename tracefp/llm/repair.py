"""Conversation structure repair by a grammar-compressed dynamic programme (operator 11).

Rows of a conversation become symbols (role initial, must go, truncated).  Re-Pair
names pairs of symbols that occur again, over all conversations a task holds at once,
so equal stretches share a rule.  Every rule has one min-plus matrix over the four
states of a conversation (nothing yet, after system, after user, after assistant):
cheapest cost and least audit between two states, the audit as a rope of the rules
below.  It is multiplied once, bottom-up, and used by every conversation.

Inserts stand before the row they precede, so an audit ends with a row's letter but at
a conversation's end.  Audits of the same rows are then free of prefixes, and the
cheapest, least one of a whole is put together from those of its parts.

Conversations that lie inside one sorted partition are finished there.  One that
crosses partitions, or is long, is cut into blocks with a matrix each; the blocks of a
conversation are then met in order, with one cost, one rank and one running hash a state.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefp.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
STATES = range(4)
START, SYSTEM, USER, ASSISTANT = STATES
GOING = 8
LEAF_CHARS = 256
BATCH_ROWS = 20_000
BLOCK_ROWS = 2_048
BLOCK_CHARS = 4_000_000
MOST_RULES = 200_000
LEGAL = {"su", "ua", "au"}
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

Rope = str | tuple
Matrix = list[tuple[int, Rope] | None]


def leaves(rope: Rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
        else:
            stack += (top[1], top[0])


def flat(rope: Rope) -> str:
    return rope if isinstance(rope, str) else "".join(leaves(rope))


def joined(a: Rope, b: Rope) -> Rope:
    """Short ropes are strings; longer ones refer to their parts."""
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= LEAF_CHARS:
        return a + b
    return a, b


def before(a: Rope, b: Rope) -> bool:
    """a < b by characters, read only as far as they agree."""
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    one, two, x, y = leaves(a), leaves(b), "", ""
    while True:
        x, y = x or next(one, ""), y or next(two, "")
        if not x or not y:
            return bool(y)
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:], y[n:]


def inserts(i: int, j: int) -> int | None:
    """Least number of inserted rows that lead from one state to another."""
    ways = {(START, USER): 1, (SYSTEM, USER): 1, (ASSISTANT, USER): 1, (USER, ASSISTANT): 1, (START, ASSISTANT): 2, (SYSTEM, ASSISTANT): 2}
    return 0 if i == j else ways.get((i, j))


def terminal(symbol: int) -> Matrix:
    """The matrix of one row behind any inserts: 2 * role + truncated, or GOING."""
    steps: list[tuple[int, int, int, str]] = [(s, s, 2, "D") for s in STATES]
    if symbol != GOING:
        role, late = divmod(symbol, 2)
        follow = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
        for s, to in follow.items():
            steps.append((s, to, 1 + 5 * late, "R"))
            if role == to:
                steps.append((s, to, 5 * late, "K"))
        if role == SYSTEM:
            steps.append((START, SYSTEM, 5 * late, "K"))
    out: Matrix = [None] * 16
    for i in STATES:
        for s, to, cost, letter in steps:
            if (n := inserts(i, s)) is not None:
                better(out, 4 * i + to, 5 * n + cost, "I" * n + letter)
    return out


def better(m: Matrix, at: int, cost: int, rope: Rope) -> None:
    was = m[at]
    if was is None or cost < was[0] or cost == was[0] and before(rope, was[1]):
        m[at] = cost, rope


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [None] * 16
    for i in STATES:
        for k in STATES:
            if (x := a[4 * i + k]) is not None:
                for j in STATES:
                    if (y := b[4 * k + j]) is not None:
                        better(out, 4 * i + j, x[0] + y[0], joined(x[1], y[1]))
    return out


def advance(vector: Matrix, m: Matrix) -> Matrix:
    """The first row of a product."""
    out: Matrix = [None] * 4
    for k in STATES:
        if (x := vector[k]) is not None:
            for j in STATES:
                if (y := m[4 * k + j]) is not None:
                    better(out, j, x[0] + y[0], joined(x[1], y[1]))
    return out


def closed(vector: Matrix) -> tuple[int, str]:
    """Cost and audit once inserts at the end have made the conversation whole."""
    out: Matrix = [None]
    for s in STATES:
        if (x := vector[s]) is not None:
            n = 0 if s == START else inserts(s, ASSISTANT)
            better(out, 0, x[0] + 5 * n, joined(x[1], "I" * n))
    return out[0][0], flat(out[0][1])


class Grammar:
    """Rules named by Re-Pair and their matrices; numbers under 9 are rows."""

    def __init__(self) -> None:
        self.matrix: list[Matrix] = [terminal(s) for s in range(GOING + 1)]
        self.rule: dict[tuple[int, int], int] = {}

    def named(self, pair: tuple[int, int]) -> int:
        n = self.rule.get(pair)
        if n is None:
            n = self.rule[pair] = len(self.matrix)
            self.matrix.append(product(self.matrix[pair[0]], self.matrix[pair[1]]))
        return n

    def compress(self, sequences: list[list[int]]) -> list[list[int]]:
        """The sequences after the most frequent pair has been named again and again,
        until no pair occurs twice.  -1 stands between sequences."""
        if len(self.matrix) > MOST_RULES:
            self.__init__()
        text = [-1, *chain.from_iterable([*s, -1] for s in sequences)]
        right, left = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for k, pair in enumerate(zip(text, text[1:])):
            if min(pair) >= 0:
                where[pair].add(k)
        heap = [(-len(at), pair) for pair, at in where.items() if len(at) > 1]
        heapq.heapify(heap)
        while heap:
            n, pair = heapq.heappop(heap)
            at = where.get(pair, ())
            if len(at) != -n:
                if len(at) > 1:
                    heapq.heappush(heap, (-len(at), pair))
                continue
            del where[pair]
            name, touched = self.named(pair), set()
            for k in sorted(at):
                nxt = right[k]
                # a place may have been taken by the same pair just before it
                if text[k] != pair[0] or nxt >= len(text) or text[nxt] != pair[1]:
                    continue
                prev, after = left[k], right[nxt]
                for spot, old in ((prev, (text[prev], pair[0])), (nxt, (pair[1], text[after]))):
                    if old in where:
                        where[old].discard(spot)
                text[k], text[nxt] = name, -2
                right[k], left[after] = after, k
                for spot, new in ((prev, (text[prev], name)), (k, (name, text[after]))):
                    if min(new) >= 0:
                        where[new].add(spot)
                        touched.add(new)
            for new in touched:
                if len(where[new]) > 1:
                    heapq.heappush(heap, (-len(where[new]), new))
        out, k = [], 0
        for s in sequences:
            k, row = right[k], []
            while text[k] >= 0:
                row.append(text[k])
                k = right[k]
            out.append(row)
        return out


class Stretch:
    """Rows of one conversation in order: their faults, counts and symbols."""

    __slots__ = ("conv", "turns", "roles", "texts", "first", "chars")

    def __init__(self, conv: int | None) -> None:
        self.conv, self.chars = conv, 0
        self.turns: list[int | None] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.first: list[bool] = []

    def add(self, turn: int | None, role: str, text: str, first: bool) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.first.append(first)
        self.chars += len(text)

    def symbols(self) -> tuple[list[int], int, int, int]:
        """Symbols, and the numbers of blank, duplicate and truncated rows."""
        out, faults = [], [0, 0, 0]
        for role, text, first in zip(self.roles, self.texts, self.first):
            shown = text.rstrip(BLANKS)
            fault = 0 if not shown else 1 if not first else 2 if shown[-1] not in ".!?" else None
            if fault is not None:
                faults[fault] += 1
            if fault in (0, 1):
                out.append(GOING)
            else:
                # 0 stands for a role that no conversation may keep
                out.append(2 * ("sua".find(role[0]) + 1 if role else 0) + (fault == 2))
        return out, *faults

    def illegal(self) -> int:
        heads = [r[:1] for r in self.roles]
        return sum(a + b not in LEGAL for a, b in zip(heads, heads[1:]))

    def lines(self, audit: str, state: int) -> Iterator[str]:
        """The repaired rows of an audit begun in a state."""
        k = 0
        for letter in audit:
            if letter in "IR":
                state = ASSISTANT if state == USER else USER
                role = "assistant" if state == ASSISTANT else "user"
                yield f"{role}:{'' if letter == 'I' else self.texts[k]}"
            elif letter == "K":
                state = "sua".find(self.roles[k][0]) + 1
                yield f"{self.roles[k]}:{self.texts[k]}"
            k += letter != "I"

    def turn_counts(self) -> tuple[int | None, int | None, int]:
        known = [t for t in self.turns if t is not None]
        return (known[0], known[-1], len(set(known))) if known else (None, None, 0)


FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = [*((x, pa.int64()) for x in FACTS), ("audit", pa.string()), ("repaired_sha256", pa.string())]
ROW = [("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("uid", pa.int64())]


def ddl(fields: list[tuple[str, pa.DataType]]) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}
    return ", ".join(f"{n} {names[t] if t in names else f'array<{names[t.value_type]}>'}" for n, t in fields)


def batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def damaged(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, uid) after damage; _act 0 marks dropped rows."""
    def spaced(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = conversations.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"),
        (F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn))) % 20).alias("act"), F.monotonically_increasing_id().alias("uid"))
    changed = F.when(F.col("act") == 1, "").when(F.col("act") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where("act <> 0").select(
        "conv", "turn", F.when(F.col("act") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"),
        F.explode(F.when(F.col("act") == 3, F.array(2 * F.col("uid"), 2 * F.col("uid") + 1)).otherwise(F.array(2 * F.col("uid")))).alias("uid"))


def in_order(rows: DataFrame) -> DataFrame:
    """Range partitions in the order conversation, turn (nulls first), role, text's
    first characters, text's hash, row; equal rows may part."""
    keys = ["conv", "turn", "role", F.left("text", F.lit(32)), F.xxhash64("text"), "uid"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def finished(done: list[Stretch], grammar: Grammar) -> list[tuple]:
    """Results of whole conversations."""
    seen = [s.symbols() for s in done]
    out = []
    for s, (_, *faults), packed in zip(done, seen, grammar.compress([x[0] for x in seen])):
        vector: Matrix = [(0, ""), None, None, None]
        for rule in packed:
            vector = advance(vector, grammar.matrix[rule])
        cost, audit = closed(vector)
        low, high, distinct = s.turn_counts()
        sha = hashlib.sha256("\n".join(s.lines(audit, START)).encode("utf-8", "surrogatepass")).hexdigest()
        out.append((s.conv, high - low + 1 - distinct if distinct else 0, *faults, s.illegal(), cost, audit, sha))
    return out


def repair_conversations(rows: DataFrame, long_rows: int = BATCH_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)
    for every conversation of (conv, turn, role, text, uid), uid unlike for every row.

    Null ids are one conversation; rows of one turn go by role and text, equal rows
    side by side.  A role without a character may not be kept.  Rows of a
    conversation that crosses partitions or has over long_rows rows are compared by
    md5, others by their text.  The digest of a conversation is one running hash, so
    its blocks pass through one task, one at a time.
    """
    parted = [("conv", pa.int64()), *RESULT, *ROW]
    blanks, no_result = (None,) * len(ROW), (None,) * len(RESULT)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, done, waiting = Grammar(), [], 0
        now: Stretch | None = None
        uids: list[int] = []
        known: set[tuple[str, str]] = set()
        far = True  # the first conversation may have begun before, a long one is passed on

        def passed() -> list[tuple]:
            return [(now.conv, *no_result, *x) for x in zip(now.turns, now.roles, now.texts, uids)]

        for b in batches:
            out: list[tuple] = []
            for conv, turn, role, text, uid in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or conv != now.conv:
                    if now is not None and not far:
                        done.append(now)
                        waiting += len(now.turns)
                    elif now is not None:
                        out += passed()
                    far, now, uids, known = now is None, Stretch(conv), [], set()
                now.add(turn, role, text, (role, text) not in known)
                known.add((role, text))
                uids.append(uid)
                if len(uids) >= long_rows or now.chars >= BLOCK_CHARS:
                    out += passed()
                    far, now, uids, known = True, Stretch(conv), [], set()
            if waiting >= BATCH_ROWS:
                out += [(*x, *blanks) for x in finished(done, grammar)]
                done, waiting = [], 0
            yield batch(out, parted)
        if now is not None:
            yield batch([(*x, *blanks) for x in finished(done, grammar)] + passed(), parted)

    block = [("conv", pa.int64()), ("seq", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("costs", pa.list_(pa.int64())),
             ("audits", pa.list_(pa.string())), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()),
             *((x, pa.int64()) for x in FACTS[1:5])]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, seq = Grammar(), TaskContext.get().partitionId() << 32
        now: Stretch | None = None

        def row() -> tuple:
            symbols, *faults = now.symbols()
            m: Matrix | None = None
            for rule in grammar.compress([symbols])[0]:
                m = grammar.matrix[rule] if m is None else product(m, grammar.matrix[rule])
            return (now.conv, seq, now.roles, now.texts, [x and x[0] for x in m], [x and flat(x[1]) for x in m], *now.turn_counts(), *faults, now.illegal())

        for b in batches:
            for conv, turn, role, text, first in zip(*(c.to_pylist() for c in b.columns)):
                if now is not None and (conv != now.conv or len(now.turns) >= block_rows or now.chars >= BLOCK_CHARS):
                    yield batch([row()], block)
                    seq, now = seq + 1, None
                now = now or Stretch(conv)
                now.add(turn, role, text, first)
        if now is not None:
            yield batch([row()], block)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Meeting | None = None
        for b in batches:
            for one in b.to_pylist():
                if now is not None and now.conv != one["conv"]:
                    yield batch([now.result()], parted[:1 + len(RESULT)])
                    now = None
                now = now or _Meeting(one["conv"])
                now.take(one)
        if now is not None:
            yield batch([now.result()], parted[:1 + len(RESULT)])

    split = materialize(in_order(rows.select("conv", "turn", "role", "text", "uid")).mapInArrow(near, ddl(parted)), "repair")
    results = ["conv", *(n for n, _ in RESULT)]
    crossing = split.where("audit IS NULL").select("conv", "turn", "role", "text", "uid", F.md5(F.concat(F.md5("role"), "text")).alias("key"))
    place = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)), "uid")
    firsts = crossing.groupBy(F.col("conv").alias("c"), F.col("key").alias("k")).agg(F.min(place).alias("least"))
    marked = crossing.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).withColumn("first", F.col("least") == place)
    met_rows = (in_order(marked.select("conv", "turn", "role", "text", "first", "uid")).select("conv", "turn", "role", "text", "first")
                .mapInArrow(blocks, ddl(block)).repartition("conv").sortWithinPartitions("conv", "seq").mapInArrow(met, ddl(parted[:1 + len(RESULT)])))
    return split.where("audit IS NOT NULL").select(*results).unionByName(met_rows)


class _Meeting:
    """Blocks of one conversation in order: for each state the least cost, the rank of
    its audit among the four, its audit as a chain of pieces, and its running hash."""

    def __init__(self, conv: int | None) -> None:
        self.conv = conv
        self.ways: dict[int, tuple[int, int, tuple | None, hashlib._Hash]] = {START: (0, 0, None, hashlib.sha256())}
        self.low: int | None = None
        self.high: int | None = None
        self.turns = 0
        self.facts = [0, 0, 0, 0]
        self.last: str | None = None

    def take(self, one: dict) -> None:
        if one["low"] is not None:
            self.turns += one["turns"] - (self.high == one["low"])
            self.low = one["low"] if self.low is None else self.low
            self.high = one["high"]
        self.facts = [a + one[x] for a, x in zip(self.facts, FACTS[1:5])]
        if self.last is not None and self.last + one["roles"][0][:1] not in LEGAL:
            self.facts[3] += 1
        self.last = one["roles"][-1][:1]
        rows = Stretch(self.conv)
        rows.roles, rows.texts = one["roles"], one["texts"]
        best: dict[int, tuple[int, int, str, int]] = {}
        for i, (cost, rank, _, _) in self.ways.items():
            for j in STATES:
                if (more := one["costs"][4 * i + j]) is not None:
                    way = cost + more, rank, one["audits"][4 * i + j], i
                    if j not in best or way[:3] < best[j][:3]:
                        best[j] = way
        ranks = {x: n for n, x in enumerate(sorted({way[1:3] for way in best.values()}))}
        ways = {}
        for j, (cost, rank, audit, i) in best.items():
            digest, begun = self.ways[i][3].copy(), i != START
            for line in rows.lines(audit, i):
                digest.update((f"\n{line}" if begun else line).encode("utf-8", "surrogatepass"))
                begun = True
            ways[j] = cost, ranks[rank, audit], (self.ways[i][2], audit), digest
        self.ways = ways

    def result(self) -> tuple:
        ends = []
        for s, (cost, rank, _, _) in self.ways.items():
            n = 0 if s == START else inserts(s, ASSISTANT)
            ends.append((cost + 5 * n, rank, "I" * n, s))
        cost, _, tail, s = min(ends)
        _, _, link, digest = self.ways[s]
        for line in Stretch(None).lines(tail, s):
            digest.update(f"\n{line}".encode())
        pieces = [tail]
        while link is not None:
            link, piece = link
            pieces.append(piece)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.facts, cost, "".join(reversed(pieces)), digest.hexdigest())


def structure_repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Damage by rule, then repair: one row per original conversation, zeros and an empty
    audit where no row is left.  Nulls of role and text are one space, and so are
    those of id and turn in the hash that picks the damage.  Further columns are not
    read; an empty table gives an empty table."""
    rows = damaged(conversations, id_col, turn_col, role_col, text_col)
    repaired = repair_conversations(rows).withColumn("left", F.lit(True))
    ids = conversations.select(F.col(id_col).cast("long").alias("conv")).distinct().withColumn("left", F.lit(False))
    nothing = {**{x: F.lit(0).cast("long") for x in FACTS}, "audit": F.lit(""), "repaired_sha256": F.lit(EMPTY_SHA)}
    both = repaired.unionByName(ids.select("conv", *(v.alias(n) for n, v in nothing.items()), "left"))
    # a conversation with rows left has two rows here, and its own result is the greater
    one = both.groupBy("conv").agg(F.max(F.struct("left", *nothing)).alias("r"))
    return one.select(F.col("conv").alias(id_col), *(F.col(f"r.{n}") for n in nothing))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
