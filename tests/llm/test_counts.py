"""Token counts of the transducer against the library."""

import random

import pytest
import sentencepiece

from tracefp.llm.transducer import Map, Transducer, default_pieces, op12_token_counts, piece_spec, token_counts

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_pieces())


@pytest.fixture(scope="module")
def machine():
    return Transducer(piece_spec(default_pieces()))


def counted(library, texts, limit=4096):
    out = []
    for i, x in texts:
        n = len(library.encode(x or ""))
        out.append((i, len((x or "").encode()), n, n > limit))
    return sorted(out, key=str)


def some_texts(machine, n):
    rng = random.Random(11)
    pieces = sorted(machine.score)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEF0123456789 .,-_\n\t\u2581<>\u00e9\u4e2d\u6587\U0001F600\x00"
    for k in range(n):
        if k % 3 == 0:
            yield "".join(rng.choice(letters) for _ in range(rng.randrange(200)))
        elif k % 3 == 1:
            yield "".join(rng.choice(pieces) for _ in range(rng.randrange(60)))
        else:
            yield "".join(rng.choice("abc =x-") * rng.randrange(1, 20) for _ in range(rng.randrange(30)))


def test_counts_of_the_table(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op12_token_counts(spark, SMALL).collect()), key=str) == counted(library, rows)


def test_random_texts(machine, library):
    for x in some_texts(machine, 300):
        assert machine.count(x) == len(library.encode(x)), x


def test_chunk_maps_compose_in_any_grouping(machine, library):
    rng = random.Random(2)
    for x in filter(None, some_texts(machine, 150)):
        size = rng.choice([1, 3, 7, 50])
        maps = [machine.chunk_map(x[max(0, a - 64):a], x[a:a + size], a == 0) for a in range(0, len(x), size)]
        while len(maps) > 1:
            k = rng.randrange(len(maps) - 1)
            maps[k:k + 2] = [Map.load(machine.compose(*maps[k:k + 2]).dump())]
        assert maps[0].entries[machine.start][1] == len(library.encode(x)), x


def test_states_that_no_context_foretold(machine, library):
    """A map without cuts and without tried states keeps its text."""
    x = "x" * 500
    first, rest = machine.chunk_map("", x[:100], True), Map({}, x[100:], None, 0)
    assert machine.compose(first, rest).entries[machine.start][1] == len(library.encode(x))


def test_long_texts_in_chunks(messy, library):
    """Nulls, empty and repeated rows, clashing columns; then every text over 40 characters in chunks."""
    rows = [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()]
    for options in ({}, {"chunk_chars": 1701, "whole_chars": 40}):
        got = sorted((tuple(r) for r in token_counts(messy, default_pieces(), 100, **options).collect()), key=str)
        assert got == counted(library, rows, 100)


def test_no_rows(messy):
    assert token_counts(messy.limit(0), default_pieces()).collect() == []


def test_states_are_dropped_beyond_the_bound(monkeypatch, library):
    from tracefp.llm import transducer

    monkeypatch.setattr(transducer, "MOST_STATES", 50)
    monkeypatch.setattr(transducer, "CACHE_UNITS", 10)
    small = Transducer(piece_spec(default_pieces()))
    for x in some_texts(small, 60):
        assert small.count(x) == len(library.encode(x)), x


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(default_pieces(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        piece_spec(str(tmp_path / "m"))
