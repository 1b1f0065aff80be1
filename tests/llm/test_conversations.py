"""Conversation repair and prefix trie against brute force."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from tracefp.llm import prefix_trie
from tracefp.llm.prefix_trie import conversation_trie, op13_conversation_trie
from tracefp.llm.repair import Grammar, closed, damaged, op11_structure_repair, product, repair_conversations, structure_repair, terminal

SHOWN = re.compile(r"[^\x20\x09-\x0D]")
COLUMNS = "conv_id long, turn long, role string, text string, conv long, path string, uid long, left boolean, sizes int, digest string"
CLASH = (1, "p", 2, True, 3, "d")


def text_order(role, text):
    return role, text[:32]


def repaired(rows):
    """Uniform-cost search in order of (cost, audit), rows by rows."""
    def spaced(x):
        return " " if x is None else x

    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        act = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        convs[conv] += [] if act == 0 else [(turn, "user" if act == 4 else role, text)] * (2 if act == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda x: ((0, 0) if x[0] is None else (1, x[0]), *text_order(*x[1:])))
        seen, counts, faults = set(), [0, 0, 0], []
        for _, role, text in own:
            shown = SHOWN.findall(text)
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            if fault is not None:
                counts[fault] += 1
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        heads = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:]))
        heap, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, k, state, lines = heapq.heappop(heap)
            if (k, state) in done:
                continue
            done.add((k, state))
            if k == len(own) and state in ("", "a"):
                break
            nxt, name = ("a", "assistant") if state == "u" else ("u", "user")
            if len(audit) < 3 * len(own) + 6:
                heapq.heappush(heap, (cost + 5, audit + "I", k, nxt, (*lines, name + ":")))
            if k < len(own):
                _, role, text = own[k]
                heapq.heappush(heap, (cost + 2, audit + "D", k + 1, state, lines))
                if faults[k] not in (0, 1):
                    late = 5 * (faults[k] == 2)
                    if role[:1] == nxt or state == "" and role[:1] == "s":
                        heapq.heappush(heap, (cost + late, audit + "K", k + 1, role[:1], (*lines, f"{role}:{text}")))
                    heapq.heappush(heap, (cost + 1 + late, audit + "R", k + 1, nxt, (*lines, f"{name}:{text}")))
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append(((0, 0) if turn is None else (1, turn), *text_order(role, text), (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + path[h:]
    nodes, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            if k:
                saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode())
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(k)).encode()).hexdigest()) for k, m in nodes.items()), key=str)


@pytest.fixture(scope="module")
def odd_rows():
    """Ties, repeated rows, nulls in every column, roles of other names, negative ids,
    one id and one turn with very many rows, and copies of whole conversations."""
    rng = random.Random(3)
    texts = ["Hi.", "Hello there", "ok!", "  ", "", "why? ", "a\nb.", None, "é中", "x"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    rows = []
    for c in range(-20, 260):
        for t in range(rng.choice([0, 1, 2, 5, 9, 14])):
            copy = c > 160
            rows.append((None if rng.random() < 0.02 else c, t if copy else rng.choice([t, t, t, None, 3 * t]),
                         "user" if copy else rng.choice(roles), f"same {t}." if copy else rng.choice(texts)))
    rows += [(7, t, ("user", "assistant")[t % 2], rng.choice(texts)) for t in range(300)] + [(8, 1, "user", "Again.")] * 200
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame([(*r, *CLASH) for r in odd_rows], COLUMNS).repartition(5)


def conversation_rows(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


SMALL = "/root/testdata/sf0.001"


def test_repair_of_the_table(spark):
    assert {r[0]: tuple(r)[1:] for r in op11_structure_repair(spark, SMALL).collect()} == repaired(conversation_rows(spark, SMALL))


def test_repair_of_odd_rows(odd, odd_rows):
    assert {r[0]: tuple(r)[1:] for r in structure_repair(odd).collect()} == repaired(odd_rows)


def test_blocks_of_long_conversations(odd, odd_rows):
    """Every conversation in blocks of three rows, met state by state."""
    rows = damaged(odd, "conv_id", "turn", "role", "text")
    got = {r[0]: tuple(r)[1:] for r in repair_conversations(rows, long_rows=2, block_rows=3).collect()}
    want = repaired(odd_rows)
    assert got == {c: want[c] for c in got} and len(got) > 200


def test_repair_of_nothing(spark, odd):
    assert structure_repair(odd.limit(0)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in structure_repair(df).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_grammar_shares_rules_and_keeps_results():
    rng = random.Random(5)
    words = [[rng.randrange(9) for _ in range(6)] for _ in range(4)]
    sequences = [[x for _ in range(rng.randrange(12)) for x in rng.choice(words)] for _ in range(60)] + [[3] * 1000, []]
    grammar = Grammar()
    packed = grammar.compress(sequences)
    spelled = {n: [n] for n in range(9)}
    for (a, b), n in grammar.rule.items():
        spelled[n] = spelled[a] + spelled[b]
    assert [[x for n in p for x in spelled[n]] for p in packed] == sequences
    pairs = [p for row in packed for p in zip(row, row[1:])]
    assert len({*pairs}) == len(pairs) or all(p[0] == p[1] for p in pairs if pairs.count(p) > 1)
    assert sum(map(len, packed)) < sum(map(len, sequences)) / 4
    for s, p in zip(sequences, packed):
        if s:
            one = terminal(s[0])
            for x in s[1:]:
                one = product(one, terminal(x))
            two = grammar.matrix[p[0]]
            for x in p[1:]:
                two = product(two, grammar.matrix[x])
            assert closed(one[:4]) == closed(two[:4])


def test_trie_of_the_table(spark):
    assert sorted((tuple(r) for r in op13_conversation_trie(spark, SMALL).collect()), key=str) == trie(conversation_rows(spark, SMALL))


@pytest.mark.parametrize("shards", ["1", "8", "30"])
def test_trie_of_odd_rows(spark, odd, odd_rows, monkeypatch, shards):
    """Any number of shards; copies lie over shards; ends and pieces in many parts."""
    monkeypatch.setattr(prefix_trie, "ENDS_CHARS", 30)
    monkeypatch.setattr(prefix_trie, "PIECE_TURNS", 3)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        assert sorted((tuple(r) for r in conversation_trie(odd).collect()), key=str) == trie(odd_rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_trie_of_nothing(odd):
    assert conversation_trie(odd.limit(0)).collect() == []


def test_a_turnless_conversation_is_at_the_root(spark):
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in range(1, 1000) if c % 5}
    lone = next(c for c in h if h[c] >= 1)
    df = spark.createDataFrame([(lone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in conversation_trie(df).collect()] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
