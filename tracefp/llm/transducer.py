"""Token counts by a compiled transducer of a piece vocabulary (operator 12).

The merging tokenizer (the adjacent pair whose joined piece scores highest, leftmost
first) is compiled to a deterministic finite transducer.  Two facts carry it.  Cutting
a token off the end of an encoded text leaves the encoding of the rest; and tokens
that each encode to themselves, and whose neighbours encode to that pair, are the
encoding of their joined text.  So the last token t of a text is the one suffix whose
pair with the last token before it holds.  A state is therefore the longest suffix
that begins a piece, and for every suffix that does, the token before it and the
tokens since.  A transition carries how many tokens the text gained by the character,
which is zero or less where the character joins tokens; a run's total is the count.

States are determined as they are reached, which keeps the automaton to what texts
need.  Where no piece holds two neighbouring characters side by side (a cut), every
state behaves alike, so a chunk's state map is short: the characters before its first
cut, and one end state and count.  A chunk without a cut maps the states that its
left context can leave, and keeps its text for any other, so the map is total.  Maps
are composed in groups, then groups of groups: a parallel prefix scan's up-sweep.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefp.llm.store import kept_in_worker

CACHE_UNITS = 400_000
CACHED_CHARS = 48
MOST_STATES = 300_000
CHUNK_CHARS = 262_144
CONTEXT_CHARS = 64
FAN_IN = 256
SPACE = "▁"
UNITS = re.compile(" +[^ ]*")
NORMAL, BYTE, KNOWN_KINDS = 1, 6, {1, 2, 3, 6}

Key = tuple[int, ...]


def piece_spec(path: str) -> str:
    """Pieces and scores of a model file, read where the job is declared; its size is
    fixed.  Only byte-fallback merging models without rewriting rules are taken."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules, trained = model.normalizer_spec, model.trainer_spec
    if trained.model_type != 2 or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
        raise ValueError("not a merging model with byte fallback")
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
        raise ValueError("the model rewrites texts")
    if kinds := {p.type for p in model.pieces} - KNOWN_KINDS:
        raise ValueError(f"pieces of kinds {sorted(kinds)}")
    return json.dumps({"prefix": rules.add_dummy_prefix, "pieces": [(p.piece, p.score) for p in model.pieces if p.type == NORMAL]})


class Map:
    """What a stretch of text does to any state: entries give end and count of the
    states tried; head, end and count those of every other (count of the end's run; no
    end: head is the whole stretch)."""

    __slots__ = ("entries", "head", "end", "count")

    def __init__(self, entries: dict[Key, tuple[Key, int]], head: str, end: Key | None, count: int) -> None:
        self.entries, self.head, self.end, self.count = entries, head, end, count

    def dump(self) -> str:
        return json.dumps([[(s, e, n) for s, (e, n) in self.entries.items()], self.head, self.end, self.count])

    @staticmethod
    def load(text: str) -> Map:
        entries, head, end, count = json.loads(text)
        return Map({tuple(s): (tuple(e), n) for s, e, n in entries}, head, None if end is None else tuple(end), count)


class Transducer:
    def __init__(self, spec: str) -> None:
        config = json.loads(spec)
        self.prefix = SPACE if config["prefix"] else ""
        self.score: dict[str, float] = dict(config["pieces"])
        self.inside = {pair for piece in self.score for pair in zip(piece, piece[1:])}
        # a mark of white space begins a unit wherever no piece holds it behind another character
        self.units_split = bool(self.prefix) and all(a == SPACE for a, b in self.inside if b == SPACE)
        # node 0 is the empty string; names number tokens alike in every process
        self.nodes = [""] + sorted({p[:k] for p in self.score for k in range(1, len(p) + 1)})
        number = {x: n for n, x in enumerate(self.nodes)}
        self.child: list[dict[str, int]] = [{} for _ in self.nodes]
        for x, n in number.items():
            if n:
                self.child[number[x[:-1]]][x[-1]] = n
        self.fits: dict[tuple[int, int], bool] = {}
        self.start: Key = (0, 0, 0)
        self._forget()
        self.cache = _Counts(self)

    def _forget(self) -> None:
        self.keys: list[Key] = []
        self.numbers: dict[Key, int] = {}
        self.next: list[dict[str, tuple[int, int]]] = []

    def _state(self, key: Key) -> int:
        n = self.numbers.get(key)
        if n is None:
            n = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
        return n

    def encode_pair(self, symbols: list[str]) -> list[str]:
        """The tokenizer's own merges, for strings as short as two pieces."""
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                score = self.score.get(symbols[k] + symbols[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return symbols
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]

    def holds(self, before: int, token: int) -> bool:
        """Whether the tokens stand side by side in an encoding (before 0: any cut)."""
        key = (before, token)
        known = self.fits.get(key)
        if known is None:
            a, b = self.nodes[before], self.nodes[token]
            if before and (a[-1], b[0]) not in self.inside:
                known = self.holds(0, token)
            else:
                known = self.encode_pair(list(a + b)) == ([a, b] if before else [b])
            self.fits[key] = known
        return known

    def _grow(self, state: int, c: str) -> tuple[int, int]:
        """The transition of a state on a character, determined on first use.

        A key is (node, token before it, tokens since) for each suffix that begins a
        piece, longest first; the empty suffix ends it.
        """
        key = self.keys[state]
        if c not in self.child[0]:
            # an unknown character is its bytes; it may never join anything
            out = self._state(self.start), len(c.encode("utf-8", "surrogatepass"))
        else:
            kept, token, gain = [], 0, 0
            for k in range(0, len(key), 3):
                node, before, since = key[k:k + 3]
                grown = self.child[node].get(c)
                if grown is None:
                    continue
                if not token and self.nodes[grown] in self.score and self.holds(before, grown):
                    token, gain = grown, 1 - since
                if self.child[grown]:
                    if before and (self.nodes[before][-1], self.nodes[grown][0]) not in self.inside:
                        before = 0
                    kept.append((grown, before, since))
            new = [x for node, before, since in kept for x in (node, before, since + gain)]
            out = self._state((*new, 0, token, 0)), gain
        self.next[state][c] = out
        return out

    def run(self, key: Key, text: str) -> tuple[Key, int]:
        """End state and tokens gained by characters that are already marked."""
        if len(self.keys) > MOST_STATES:
            self._forget()
        state, count, table = self._state(key), 0, self.next
        for c in text:
            hit = table[state].get(c) or self._grow(state, c)
            state = hit[0]
            count += hit[1]
        return self.keys[state], count

    def apply(self, m: Map, key: Key) -> tuple[Key, int]:
        if key in m.entries:
            return m.entries[key]
        end, count = self.run(key, m.head)
        return (end, count) if m.end is None else (m.end, count + m.count)

    def compose(self, a: Map, b: Map) -> Map:
        def then(end: Key, count: int) -> tuple[Key, int]:
            last, more = self.apply(b, end)
            return last, count + more

        entries = {s: then(*x) for s, x in a.entries.items()}
        if a.end is not None:
            return Map(entries, a.head, *then(a.end, a.count))
        return Map(entries, a.head + b.head, b.end, b.count)

    def _units(self, text: str) -> list[str]:
        """Runs that each begin with a mark, without that first mark."""
        text = text.replace(SPACE, " ")
        if text[0] != " " and "  " not in text:
            return text.split(" ")
        return [x[1:] for x in UNITS.findall(" " + text)]

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if self.units_split:
            return sum(map(self.cache.__getitem__, self._units(text)))
        return self.run(self.start, self.prefix + text.replace(" ", SPACE))[1]

    def chunk_map(self, before: str, text: str, first: bool) -> Map:
        """The state map of a chunk behind the characters before it."""
        before, text = before.replace(" ", SPACE), text.replace(" ", SPACE)
        if first:
            return Map({self.start: self.run(self.start, self.prefix + text)}, "", None, 0)
        pairs = zip((before[-1:] or " ") + text, text)
        known, inside = self.child[0], self.inside
        cut = next((k for k, (a, b) in enumerate(pairs) if (a, b) not in inside or a not in known), None)
        if cut is not None:
            return Map({}, text[:cut], *self.run(self.start, text[cut:]))
        starts = {self.run(self.start, before[k:])[0] for k in range(len(before))}
        entries: dict[Key, tuple[Key, int]] = {}
        met: dict[tuple[int, Key], tuple[Key, int]] = {}
        # states that meet at a mark of the way go on as one
        stops = range(0, len(text), 256)
        for s in sorted(starts):
            key, count, passed = s, 0, []
            for at in stops:
                if (at, key) in met:
                    end, more = met[at, key]
                    break
                passed.append((at, key, count))
                key, n = self.run(key, text[at:at + 256])
                count += n
            else:
                end, more = key, 0
            for at, k, n in passed:
                met[at, k] = end, count + more - n
            entries[s] = end, count + more
        return Map(entries, text, None, 0)


class _Counts(dict):
    """Tokens of each unit met, run once while a bounded cache keeps it."""

    def __init__(self, of: Transducer) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, unit: str) -> int:
        n = self.of.run(self.of.start, SPACE + unit.replace(" ", SPACE))[1]
        if len(unit) <= CACHED_CHARS:
            if len(self) >= CACHE_UNITS:
                self.clear()
            self[unit] = n
        return n


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text",
                 chunk_chars: int = CHUNK_CHARS, whole_chars: int | None = None) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for every row.

    Texts of up to whole_chars characters (four chunks) run in the task that reads
    them; longer ones are dealt out as chunks, whose maps meet in groups of FAN_IN.
    Null text is empty text, which has no tokens; strings that spell special tokens
    are ordinary text.  Repeated rows and null ids give a row each; further columns
    are not read; an empty table gives an empty table.
    """
    whole = 4 * chunk_chars if whole_chars is None else whole_chars
    shared = docs.sparkSession.sparkContext.broadcast(piece_spec(path))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    kind = dict(rows.dtypes)["id"]

    def machine() -> Transducer:
        return kept_in_worker(f"transducer {hash(shared.value)}", lambda: Transducer(shared.value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = machine().count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(count, batch.column(2).to_pylist()), pa.int64())],
                                             ["id", "n_bytes", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = x.as_py()
                for k, at in enumerate(range(0, len(x), chunk_chars)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row], pa.int64()), pa.array([k], pa.int64()), pa.array([x[max(0, at - CONTEXT_CHARS):at]], pa.string()),
                         pa.array([x[at:at + chunk_chars]], pa.string())], ["row", "k", "before", "chunk"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = machine().chunk_map
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([of(b, x, k == 0).dump() for _, k, b, x in zip(*cols)], pa.string())],
                                             ["row", "k", "map"])

    def composed(group: pd.DataFrame) -> pd.DataFrame:
        m = machine()
        maps = [Map.load(x) for x in group.sort_values("k")["map"]]
        while len(maps) > 1:
            pairs = [m.compose(*maps[k:k + 2]) for k in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(maps) - len(maps) % 2:]
        return pd.DataFrame({"row": [group["row"].iloc[0]], "k": [group["k"].min() // FAN_IN], "map": [maps[0].dump()]})

    def total(maps: pd.Series) -> pd.Series:
        return maps.map(lambda x: Map.load(x).entries[machine().start][1])

    short = rows.where(F.char_length("text") <= whole).select("id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    out = short.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")

    # the same scan numbers its rows alike each time
    long = rows.where(F.char_length("text") > whole).withColumn("row", F.monotonically_increasing_id())
    maps = (long.select("row", "text").mapInArrow(cut, "row long, k long, before string, chunk string").repartition("row", "k")
            .mapInArrow(mapped, "row long, k long, map string"))
    # a text has at most 2^31 bytes: two rounds of 256 maps hold any
    for _ in range(2 if chunk_chars * FAN_IN * FAN_IN >= 1 << 31 else 4):
        maps = maps.groupBy("row", F.expr(f"k DIV {FAN_IN}")).applyInPandas(composed, "row long, k long, map string")
    whole_maps = maps.select("row", F.pandas_udf(total, "long")("map").alias("n_tokens"))
    far = long.select("id", "row", F.octet_length("text").cast("long").alias("n_bytes")).join(whole_maps, "row").select("id", "n_bytes", "n_tokens")
    return out.unionByName(far).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, default_pieces())
