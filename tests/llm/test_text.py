"""Decontamination, language-model scores, licences, toxicity and secrets."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefp.llm import gru, toxicity
from tracefp.llm.contamination import THRESHOLD, Index, contaminated, decontaminate, question_answer
from tracefp.llm.licenses import folders, license_scan
from tracefp.llm.ngrams import lm_scores
from tracefp.llm.secrets import candidates, coverage, known_labels, scan_secrets, train_forest


@pytest.fixture(scope="module")
def items(prose):
    return [(k, prose(500 + k, 14 + k) + ". " + prose(900 + k, 9) + ".") for k in range(20)] + [(90, None), (91, ""), (92, "..."), (93, prose(77, 300))]


def test_wand_finds_what_a_full_scan_finds(items):
    index, r = Index(items), random.Random(2)
    terms = sorted(index.terms.values())
    for _ in range(200):
        asked = sorted(r.sample(terms, 40))
        scores = Counter()
        for t in asked:
            for u, x in zip(index.units[t], index.impacts[t]):
                scores[u] += x
        for least in (0.05, 0.2, 0.5):
            want = {u for u, x in scores.items() if x >= least}
            got = index.wand(asked, set(range(index.n_blocks)), least)
            assert {u for u, _ in got} == want and all(abs(scores[u] - x) < 1e-9 for u, x in got)


def test_passage_bounds_lose_nothing(items, prose):
    index = Index(items)
    texts = [prose(k, 150) + " " + items[k % 20][1] + " " + prose(k + 50, 90) for k in range(30)] + [items[23][1], None, "", prose(1, 5)]
    got = {(t, i) for t, i, *_ in index.search(texts, THRESHOLD)}
    assert got == {(k, k % 20) for k in range(30)} | {(30, 23)}


def test_contaminated_rows_go(spark, frame, messy, items, prose):
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(1))
    q, a = (" ".join(w.decode() for w in x) for x in question_answer(items[4][1]))
    edited = items[5][1].split()
    edited[3] = "other"
    docs = frame([(1, prose(1, 200) + " " + items[3][1].upper() + " " + prose(2, 90)), (2, q), (3, q + " ! " + a), (4, prose(9, 300)), (5, None), (6, ""),
                  (None, items[3][1]), (7, " ".join(edited)), (8, items[23][1]), (8, prose(3, 40))])
    got = sorted((r.doc_id is None, r.doc_id, r.item_id) for r in contaminated(docs, bench).collect())
    assert got == [(False, 1, 3), (False, 3, 4), (False, 8, 93), (True, None, 3)]
    assert sorted(str(r.doc_id) for r in decontaminate(docs, bench).collect()) == ["2", "4", "5", "6", "7", "None"]
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate(messy, bench).columns == messy.columns and decontaminate(messy, bench).count() == messy.count()


def plain_backoff(texts):
    bags = [[tuple(w[k:k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)] for w in texts]
    total, words = Counter(g for b in bags for g in b), sum(map(len, texts))
    out = []
    for w, bag in zip(texts, bags):
        own, log = Counter(bag), 0.0
        left = lambda g: total[g] - own[g]
        for i in range(len(w)):
            most = min(i + 1, 3)
            for k in range(most, 0, -1):
                g = tuple(w[i - k + 1:i + 1])
                if left(g):
                    log += (most - k) * math.log(0.4) + math.log(left(g) / (left(g[:-1]) if k > 1 else words - len(w)))
                    break
            else:
                log += most * math.log(0.4) - math.log(words - len(w) + 1)
        out.append((len(w), log))
    return out


def test_backoff_scores_against_plain_counts(messy, frame, prose, monkeypatch):
    import tracefp.llm.ngrams as lm

    monkeypatch.setattr(lm, "PART_GRAMS", 500)
    more = messy.unionByName(frame([(100 + k, prose(k % 4, 30 + k)) for k in range(20)]))
    rows = more.collect()
    want = plain_backoff([(r.text or "").encode().split() for r in rows])
    got = lm_scores(more).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, round(r.log_score, 5)) for r in got) == sorted(
        (r.doc_id is None, r.doc_id or 0, n, round(x, 5) + 0.0) for r, (n, x) in zip(rows, want))
    assert all((r.mean_log is None) == (r.n_words == 0) for r in got)
    assert lm_scores(messy.limit(0)).count() == 0


def test_licences_are_inherited_from_the_nearest_folder(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "code"), (3, "a/b/COPYING.txt", "notes\n" * 50 + "Licensed under the Apache License, Version 2.0."),
            (4, "a/b/y.py", "# Licensed under CC BY-NC 4.0.\ncode " + "z " * 400), (5, "d/x", "about licences"), (6, None, "text"), (7, "a/q", None), (8, "/a/", ""),
            (2, "a/b/c/x.py", "code"), (None, "a/b/z", ""), (9, "e", "L" * 30000), (10, "d/e/f", "permission " * 200)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, path string, text string, license string, row int")
    got = sorted((r.doc_id or 0, r.license, r.how, r.folder) for r in license_scan(docs).collect())
    assert got == sorted([(1, "mit", "own", None), (2, "apache-2.0", "inherited", "a/b"), (2, "apache-2.0", "inherited", "a/b"), (3, "apache-2.0", "own", None),
                          (4, "cc-by-nc-4.0", "own", None), (5, None, "none", None), (6, None, "none", None), (7, "mit", "inherited", "a"), (8, None, "none", None),
                          (0, "apache-2.0", "inherited", "a/b"), (9, None, "none", None), (10, None, "none", None)], key=lambda r: (r[0],))
    assert license_scan(docs.limit(0)).count() == 0
    plan = license_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert spark.range(1).select(folders(F.lit("/a//b/c")).alias("f")).first().f == ["", "a", "a/b"]


def test_gradients_of_the_network():
    """One step of descent follows the numeric gradient of the loss."""
    words = [b"abc", b"defghij", b"k", b"abcdefghijklmnopqrstuvwx", b"zz"]
    ids, weights = gru.features(words)
    p = {k: v.astype(np.float64) for k, v in gru.initial(1).items()}
    gates = gru.project(p, gru.embed(p, ids, weights))
    order, sizes = np.array([[0, 1, 2, 3], [4, 1, 0, 0], [2, 0, 0, 0]]), np.array([4, 2, 1])
    whole = gru.logits(p, gates, order, sizes)
    back = gru.logits(p, gates, order[::-1], sizes[::-1])[::-1]
    assert np.allclose(whole, back, atol=1e-5)
    # a window's logit does not depend on its neighbours in the batch
    for k in range(3):
        assert np.allclose(gru.logits(p, gates, order[k:k + 1], sizes[k:k + 1]), whole[k], atol=1e-5)


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        first, size, text = toxicity.window_table(np.array([n, 5]))
        own = text == 0
        assert set(range(n)) == {w for a, s in zip(first[own], size[own]) for w in range(a, a + s)} and (size <= toxicity.WINDOW).all()


def test_training_texts_are_drawn_over_their_whole_length(spark):
    """Short texts whole; of a long one equal pieces from its first character to its last."""
    long = " ".join(f"w{k}" for k in range(2_000))
    rows = spark.createDataFrame([(1, "a b"), (2, long), (3, ""), (4, None)], "id long, text string")
    got = {r.id: r.t for r in rows.select("id", toxicity.spread(F.col("text"), 200, 10).alias("t")).collect()}
    pieces = [long[k * (len(long) - 20) // 9:][:20] for k in range(10)]
    assert got == {1: "a b", 2: " ".join(pieces), 3: "", 4: None} and long.endswith(pieces[-1])


def test_toxicity_is_learned_and_kept_apart(spark, frame, messy, prose, quick_network):
    r = random.Random(5)
    rows, labels = [], []
    for k in range(160):
        words, bad = prose(k, 80).split(), k % 4 == 0
        if bad:
            for _ in range(6):
                words.insert(r.randrange(len(words)), r.choice(["vilething", "nastyword", "grimslur"]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    labels += [(None, 0, 1), (1, None, None), (9999, 0, 1), (3, 1, 0)]
    docs, marks = frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train_toxicity(docs, marks)
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(docs, model).collect()}
    held = {x.doc_id for x in docs.where(toxicity.held_out(F.col("doc_id"))).collect()}
    assert 20 < len(held) < 60
    right = sum((got[k] >= toxicity.THRESHOLD) == (k % 4 == 0) for k in held)
    assert right >= 0.9 * len(held)
    # labels of rows that are held out are never used
    turned = marks.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train_toxicity(docs, turned)
    assert all(np.array_equal(model["network"][k], again["network"][k]) for k in model["network"]) and np.allclose(model["slope"], again["slope"])
    odd = toxicity.score_toxicity(messy, model).collect()
    assert len(odd) == messy.count() and all(0 <= x.score <= 1 for x in odd)
    kept = toxicity.keep_clean(messy, model)
    assert kept.columns == messy.columns and kept.where("text IS NULL OR trim(text) = ''").count() == messy.where("text IS NULL OR trim(text) = ''").count()
    assert toxicity.score_toxicity(messy.limit(0), model).count() == 0
    bare = toxicity.train_toxicity(docs, marks.limit(0))
    assert {x.score for x in toxicity.score_toxicity(messy, bare).collect()} == {0.0}


def test_secrets_stay_and_lookalikes_go(frame, messy):
    r = random.Random(9)
    def mixed(n, pool="0123456789abcdef"):
        return "".join(r.choice(pool) for _ in range(n))
    rows = []
    for k in range(80):
        rows.append((k, f"use token = \"{mixed(40)}\" here and card {mixed(16, '0123456789')} too, release-202{k % 10}, password={mixed(18)} AKIA{mixed(16, 'ABCDEFGH234567')}"))
    docs = frame(rows)
    found = candidates(docs, ["card", "release", "token"])
    labels = found.withColumn("label", known_labels(F.col("value"), F.col("before")))
    assert {x.label: x["count"] for x in labels.groupBy("label").count().collect()} == {1: 240, 0: 160}
    model = train_forest(labels.where("id % 2 = 0"))
    got = {x.doc_id: x for x in scan_secrets(docs, found, model).collect()}
    for k, text in rows:
        spots = [text[s.begin:s.begin + s.length] for s in got[k].secrets]
        assert got[k].n_candidates == 5 and len(spots) == 3 and not any(s.isdigit() or s.startswith("release") for s in spots)
    assert train_forest(labels.where("label = 1")) == 1.0 and train_forest(labels.limit(0)) == 0.0
    odd = scan_secrets(messy, candidates(messy, []), model).collect()
    assert len(odd) == messy.select("doc_id").distinct().count()
    assert scan_secrets(messy.limit(0), candidates(messy.limit(0), []), model).count() == 0
    assert coverage("tokencard99", frozenset(["token", "card"])) == 9 / 11


def test_replies_of_rare_ngrams_are_small():
    """Most n-grams of a chunk occur once; all replies of a chunk meet in one row."""
    import numpy as np
    import pyarrow as pa

    from tracefp.llm import ngrams

    rng = np.random.default_rng(5)
    both = np.unique(rng.integers(0, 1 << 46, 500, np.uint64))
    chunks = [np.unique(np.concatenate([both, rng.integers(0, 1 << 46, 40_000, np.uint64)])) for _ in range(2)]
    out = ngrams._counted(pa.table({"part": [0, 0], "chunk": [0, 1], "keys": [ngrams._pack_keys(k) for k in chunks],
                                    "counts": [ngrams._pack(np.ones(len(k), np.uint64), 4) for k in chunks]}))
    for keys, totals in zip(chunks, out.column("totals").to_pylist()):
        assert len(totals) < len(keys) and np.array_equal(ngrams._unpack_totals(totals), np.where(np.isin(keys, both), 2, 0))
    assert len(ngrams._unpack_totals(ngrams._pack_totals(np.zeros(0, np.uint64)))) == 0


def test_cached_words_stay_within_their_room(monkeypatch):
    """Many chunks of new words: the table of the cache is taken once, and scores are those of a fresh cache."""
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 500)
    monkeypatch.setattr(toxicity, "CHUNK_WORDS", 300)
    model = {"network": gru.initial(1), "prior": 0.1, "shift": np.zeros(6), "slope": np.full(6, 0.1)}
    texts = [" ".join(f"w{(31 * k + j) % 1999}" for j in range(200)) for k in range(40)] + ["", None, "one"]
    scorer, found, room = toxicity.Scorer(model), [], 0
    for k in range(0, len(texts), 2):
        found += scorer.score(texts[k:k + 2]).tolist()
        room = max(room, len(scorer.gates))
    assert room == 500
    assert found == pytest.approx([float(toxicity.Scorer(model).score([t])[0]) for t in texts], abs=1e-6)
    # a chunk of more different words than the cache holds is still scored whole
    wide = " ".join(f"v{j}" for j in range(1200))
    assert scorer.score([wide])[0] == pytest.approx(toxicity.Scorer(model).score([wide])[0], abs=1e-6) and len(scorer.index) == 1200
