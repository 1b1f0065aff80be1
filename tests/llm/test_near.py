"""SimHash groups, line dedup and embeddings against brute force."""

import re

import numpy as np
import pytest
import xxhash

from tracefp.llm import golay
from tracefp.llm.components import components
from tracefp.llm.lines import line_dedup
from tracefp.llm.simhash import near_links, similar_groups, simhash_dedup, simhash_groups
from tracefp.llm.vectors import near_vectors


class Sets:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def root(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def link(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k:k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_code_is_perfect_and_one_error_shares_an_index():
    _, own, further = golay.tables()
    assert (own >= 0).all() and (further >= 0).sum() == 8855
    words = np.random.default_rng(1).integers(0, 1 << 23, 4000)
    near = golay.near_indices(words)
    for bit in range(23):
        assert (near == golay.own_index(words ^ (1 << bit))[:, None]).any(1).all()


def test_components_of_chains_stars_and_odd_links(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 60)] + [(3, 3), (None, 4), (5, None), (2, 1), (1, 2), (2, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, **{k: 7 for k in range(7, 60)}, 1: 1, 2: 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bucket", [2, 64])
def test_links_of_families_of_near_fingerprints(spark, bucket):
    r = np.random.default_rng(3)
    found = set()
    for base in r.integers(0, 1 << 62, 12):
        for _ in range(30):
            x = int(base)
            for b in r.integers(0, 64, r.integers(0, 6)):
                x ^= 1 << int(b)
            found.add(x)
    fps = sorted(found)
    sets = Sets(range(len(fps)))
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2:
                sets.link(i, j)
    df = spark.createDataFrame([(signed(x), n) for n, x in enumerate(fps)], "fp long, rep long")
    got = {r.node: r.component for r in components(near_links(df, bucket)).collect()}
    assert all(got.get(n, n) == sets.root(n) for n in range(len(fps)))


def test_simhash_groups_of_messy_rows(messy):
    rows = messy.collect()
    got = simhash_groups(messy).collect()
    assert len(got) == len(rows)
    texts = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp) for r in got) == sorted((i is None, i or 0, signed(f)) for i, f in texts)
    named = [(i, f) for i, f in texts if i is not None]
    sets = Sets({i for i, _ in named})
    for i, f in named:
        for j, g in named:
            if (f ^ g).bit_count() <= 2:
                sets.link(i, j)
    assert all(r.component_id == (None if r.doc_id is None else sets.root(r.doc_id)) for r in got)
    kept = simhash_dedup(messy)
    assert kept.columns == messy.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {sets.root(i) for i, _ in named}


def test_documents_of_five_word_similarity_are_one(frame, prose):
    """Near copies whose fingerprints are far apart, and a crowd; against all pairs."""
    r = np.random.default_rng(6)
    texts = []
    for k in range(8):
        for changes in (0, 1, 2, 4):
            words = prose(300 + k, 120).split()
            for at in r.choice(120, changes, replace=False):
                words[at] = f"w{len(texts)}x{at}"
            texts.append(" ".join(words))
    for n in range(40):
        words = prose(400, 120).split()
        for at in r.choice(120, 1 + n % 2, replace=False):
            words[at] = f"w{r.integers(0, 9)}"
        texts.append(" ".join(words))
    grams = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    sets = Sets(range(len(texts)))
    for i, a in enumerate(grams):
        for j in range(i):
            if len(a & grams[j]) >= 0.8 * len(a | grams[j]):
                sets.link(i, j)
    got = similar_groups(frame(list(enumerate(texts)))).collect()
    assert {x.doc_id: x.component_id for x in got} == {n: sets.root(n) for n in range(len(texts))}
    kept = simhash_dedup(frame(list(enumerate(texts[:8])))).select("doc_id").collect()
    assert {x.doc_id for x in kept} == {sets.root(n) for n in range(8)}


def test_documents_of_near_fingerprints_are_one(frame, prose):
    """The dedup takes the links of the fingerprints where five-word sets differ, and joins
    both kinds: 9 is like 2 by its words, 2 like 1 by its fingerprint."""
    verse = "the same old song goes on and on again "
    texts = {1: verse * 200 + prose(1, 30), 2: verse * 200 + prose(2, 30), 5: prose(3, 120)}
    texts[9] = texts[2] + " end"
    fps = {n: plain_fingerprint(t) for n, t in texts.items()}
    sets = {n: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for n, t in texts.items()}
    assert (fps[1] ^ fps[2]).bit_count() <= 2 and len(sets[1] & sets[2]) < 0.8 * len(sets[1] | sets[2])
    assert len(sets[9] & sets[2]) >= 0.8 * len(sets[9] | sets[2])
    assert sorted(r.doc_id for r in simhash_dedup(frame(list(texts.items()))).collect()) == [1, 5]


def test_empty_tables(spark, messy):
    none = messy.limit(0)
    assert simhash_groups(none).count() == 0 and simhash_dedup(none).count() == 0
    assert line_dedup(none).count() == 0
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def plain_shingles(line):
    return {line[m.start() + k:m.start() + k + 10] for m in re.finditer(r"\S+", line) for k in range(0, len(m[0]), 8)}


def plain_lines(docs):
    """(doc_id, text) -> text with the lines that stay; ids unique."""
    first = {}
    for doc_id, text in sorted((d for d in docs if d[1] is not None), key=lambda d: d[0]):
        for pos, line in enumerate(text.split("\n")):
            if line.strip(" "):
                first.setdefault(line.strip(" ").lower(), (doc_id, pos))
    lines = list(first)
    sets = Sets(first.values())
    shingles = [plain_shingles(x) for x in lines]
    for i, a in enumerate(shingles):
        for j in range(i):
            both = len(a & shingles[j])
            if both and both >= 0.8 * (len(a) + len(shingles[j]) - both):
                sets.link(first[lines[i]], first[lines[j]])
    return {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip(" ") or sets.root(first[x.strip(" ").lower()]) == (d, p))
            for d, t in docs}


def test_line_dedup_against_all_pairs(frame, prose):
    base = [prose(k, 30) for k in range(12)]
    docs = []
    for n in range(60):
        lines = [base[n % 12], base[(n * 5) % 12].replace(" ", "  ", 1), prose(100 + n, 25), "", base[n % 12].upper() + " tail%d" % (n % 3)]
        words = base[n % 7].split()
        words[n % 30] = "changed%d" % n
        docs.append((n, "\n".join([*lines, " ".join(words), "short", "x" * (n % 4)])))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "中文字符" * 30), (104, "中文字符" * 30 + "\n" + "a" * 20000)]
    want = plain_lines(docs[:-2])
    got = {r.doc_id: r for r in line_dedup(frame(docs)).collect()}
    assert {k: got[k].text for k in want} == want
    assert got[103].text and got[104].text == "a" * 20000 and got[100].n_lines == 0 and got[101].n_lines == 1
    crowded = {r.doc_id: r.text for r in line_dedup(frame(docs), crowd=10).collect()}
    assert {k: crowded[k] for k in want} == want


@pytest.mark.parametrize(("changes", "own"), [(1, 0), (2, 0), (0, 3)])
def test_line_dedup_of_crowded_families(frame, prose, changes, own):
    """Lines that change some words of one line, or share a long template."""
    r = np.random.default_rng(changes)
    base, docs = prose(3, 40).split(), []
    for n in range(300):
        words = list(base)
        for at in r.integers(0, 40, changes):
            words[at] = f"w{r.integers(0, 1000)}"
        docs.append((n, " ".join(words + [f"own{r.integers(0, 40)}x{k}" for k in range(own)])))
    want = plain_lines(docs)
    got = {r.doc_id: r.text for r in line_dedup(frame(docs)).collect()}
    assert got == want


def test_lines_without_spaces_survive_an_insertion(frame):
    r = np.random.default_rng(5)
    base = "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz0123456789/="), 400))
    thai = "".join(r.choice([chr(c) for c in range(0x0E01, 0x0E2F)], 400))
    docs = [(1, base), (2, base[:37] + "x" + base[37:]), (3, base[:200] + base[201:]), (4, thai), (5, thai[:90] + thai[50] + thai[90:]), (6, base[::-1])]
    assert [r.text for r in line_dedup(frame(docs)).orderBy("doc_id").collect()] == [base, "", "", thai, "", base[::-1]]


def test_line_dedup_of_messy_rows(messy):
    got = line_dedup(messy, n_chars_col="n_chars")
    assert got.columns == [*messy.columns, "n_lines", "n_dropped"]
    rows = got.collect()
    assert len(rows) == messy.count()
    assert sum(r.text is None for r in rows) == 2
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    # the row without an id comes first, so the copies of its line go; repeated rows get the same
    by = {r.doc_id: r for r in rows}
    assert by[1].text == "" and by[13].text.count("\n") == 0 and by[13].n_dropped == 2


def test_line_dedup_uses_no_python(messy):
    plan = line_dedup(messy)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_vectors(rows, least):
    unit = {}
    for n, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and rows[n][0] is not None:
            x = np.array(v, np.float64)
            unit[n] = x / np.linalg.norm(x)
    # a node is an id with a vector
    node = [None if i is None else (i, str(v)) for i, v in rows]
    links, sets = dict.fromkeys(range(len(rows)), 0), Sets({x for x in node if x is not None})
    for a in unit:
        for b in unit:
            if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[a] += 1
                sets.link(node[a], node[b])
    return sorted((i is None, i or 0, links[n], -1 if i is None else sets.root(node[n])[0]) for n, (i, _) in enumerate(rows))


def test_vectors_against_all_pairs(spark):
    r = np.random.default_rng(7)
    rows = []
    for k in range(12):
        base = r.normal(size=16)
        rows += [(len(rows) + j, (base + r.normal(size=16) * 0.25 * r.random()).astype("f4").tolist()) for j in range(40)]
    rows += [(1000 + k, rows[3][1]) for k in range(30)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] + [1.0] * 15), (2005, [float("inf")] * 16),
             (2006, rows[3][1][:5]), (2007, rows[3][1][:5]), (None, rows[3][1]), (3, rows[3][1]), (3, rows[90][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cell string, n int")
    want = plain_vectors(rows, 0.95)
    for block, cell in ((1024, 1000), (20, 30)):
        got = near_vectors(df, block=block, cell=cell).collect()
        assert sorted((x.vec_id is None, x.vec_id or 0, x.n_links, -1 if x.vec_id is None else x.component_id) for x in got) == want
        assert all(x.kept == (x.vec_id is not None and x.vec_id == x.component_id) for x in got)


def test_vectors_meet_in_rounds_of_bounded_size(spark, monkeypatch):
    """No round shuffles many more copies than there are vectors, and together they find every pair, once."""
    from tracefp.llm import vectors

    r = np.random.default_rng(8)
    rows = [(k, (r.normal(size=12) * 0.3 + np.eye(12)[k % 3]).tolist()) for k in range(240)]
    rows += [(240 + k, (np.array(rows[k % 60][1]) + r.normal(size=12) * 0.05).tolist()) for k in range(240)]
    copies, all_of = [], vectors._pairs

    def counted(*args):
        out = all_of(*args)
        copies.append(out.count())
        return out

    monkeypatch.setattr(vectors, "_pairs", counted)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = near_vectors(df, block=20, cell=30, least_round=100).collect()
    assert sorted((x.vec_id is None, x.vec_id, x.n_links, x.component_id) for x in got) == plain_vectors(rows, 0.95)
    assert len(copies) > 3 and max(copies) <= 1.5 * len(rows) and sum(x.n_links for x in got) > 400
    whole = len(copies), sum(copies)
    copies.clear()
    near_vectors(df, block=20, cell=30)
    assert len(copies) == 1 < whole[0] and copies[0] == whole[1]


def test_line_dedup_keeps_clear_of_its_own_names(frame, prose):
    """A table that has n_lines and N_DROPPED keeps them; the new ones are set apart."""
    docs = frame([(1, prose(1, 20) + "\n" + prose(1, 20)), (2, None)]).selectExpr("doc_id", "text", "-1 AS n_lines", "'mine' AS N_DROPPED")
    got = line_dedup(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "N_DROPPED", "_n_lines", "_n_dropped"]
    rows = {r.doc_id: tuple(r)[2:] for r in got.collect()}
    assert rows == {1: (-1, "mine", 2, 1), 2: (-1, "mine", 0, 0)}
