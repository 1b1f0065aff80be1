"""Stupid-backoff language-model scores from n-gram counts of the whole corpus (operator 4).

Words are runs without ASCII white space.  A document is scored by the counts of all
others: its own counts are taken off, so that backing off means something.  With
c the counts that are left, N their words and K = min(i, 3) for the i-th word,

    S(w_i) = 0.4^(K-k) c(k-gram ending at i) / c(its first k-1 words)

for the longest k-gram that is left, with N below the fraction for k = 1, and
0.4^K / (N + 1) if the word itself is not.

The counts are relations in blocks.  Documents lie in chunks of about CHUNK_CHARS
characters.  Each chunk is exploded to its n-grams, counted within the chunk before any
shuffle, and dealt by hash to partitions of about PART_GRAMS n-grams; a row is what
one chunk has in one partition, as packed arrays.  In a partition the count tables
of all orders are summed and joined to the rows, and each chunk gets back the counts
of its n-grams, zero for one that occurs once (which is its own document's).  Joined
to its chunk by number, they are summed per document.  A frequent n-gram is one
entry a chunk; no partition grows with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefp.llm.store import settled

ORDER, ALPHA = 3, 0.4
CHUNK_CHARS = 3_000_000
PART_GRAMS = 1_500_000
KEY_BYTES = 6
MOST_PARTS = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def gram_hashes(texts: list[list[bytes]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(hashes of the n-gram ending at each word for each order, document and place of
    each word); the hash is zero where a document has too few words before."""
    counts = np.array([len(t) for t in texts], np.int64)
    known: dict[bytes, int] = {}
    index = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(counts.sum()))
    word = np.array([xxhash.xxh64_intdigest(w, 42) for w in known], np.uint64)[index] if len(index) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = [_mix(word + np.uint64(1)) | np.uint64(1)]
    for n in range(2, ORDER + 1):
        before = np.concatenate(([np.uint64(0)], out[-1][:-1])) if len(word) else out[-1]
        made = _mix(before * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(n)) | np.uint64(1)
        out.append(np.where(place >= n - 1, made, np.uint64(0)))
    return out, doc, place


def _pack(keys: np.ndarray, size: int) -> bytes:
    """Byte planes, which compress where the values are close."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _unpack(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(size, -1).T
    return out.reshape(-1).view("<u8")


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences, whose upper bytes are mostly zero."""
    return _pack(np.diff(keys, prepend=np.uint64(0)), KEY_BYTES)


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, KEY_BYTES), dtype=np.uint64)


def _pack_totals(totals: np.ndarray) -> bytes:
    """Compressed: most n-grams occur once, and a chunk gets all its replies at the same time."""
    return zstandard.ZstdCompressor(1).compress(_pack(totals, 8)) if len(totals) else b""


def _unpack_totals(raw: bytes) -> np.ndarray:
    return _unpack(zstandard.ZstdDecompressor().decompress(raw) if raw else b"", 8)


def _split(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(partition, key): from different bits of the hash."""
    low = hashes & np.uint64(MOST_PARTS - 1)
    return (low * np.uint64(parts) // np.uint64(MOST_PARTS)).astype(np.int64), hashes >> np.uint64(16)


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, ids, n_words, texts): rows of documents of about CHUNK_CHARS characters."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, press = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(1)

        def row(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            return pa.RecordBatch.from_arrays([
                pa.array([(part << 32) + n]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([[len(r) for r in raw]], pa.list_(pa.int64())), pa.array([press.compress(b"".join(raw))], pa.binary())], ["chunk", "ids", "sizes", "texts"])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            start = total = 0
            for k, t in enumerate(texts):
                total += len(t)
                if total >= CHUNK_CHARS or k == len(texts) - 1:
                    yield row(batch.column(0).slice(start, k + 1 - start), texts[start:k + 1])
                    start, total, n = k + 1, 0, n + 1

    return rows.mapInArrow(run, f"chunk long, ids array<{kind}>, sizes array<long>, texts binary")


def _texts(sizes: list[int], raw: bytes) -> list[list[bytes]]:
    data = zstandard.ZstdDecompressor().decompress(raw) if sum(sizes) else b""
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(int).tolist()
    return [data[a:b].split() for a, b in zip(ends, ends[1:])]


def _dealt(grams: list[np.ndarray], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, by, heads): different n-grams of a chunk in ascending order, the
    order that deals them to partitions, and where each partition begins in it."""
    hashes, counts = np.unique(np.concatenate(grams), return_counts=True)
    hashes, counts = hashes[hashes > 0], counts[hashes > 0]
    part, _ = _split(hashes, parts)
    by = np.argsort(part, kind="stable")
    return hashes, counts, by, np.searchsorted(part[by], np.arange(parts + 1))


def _exploded(table: DataFrame, parts: int) -> DataFrame:
    """(part, chunk, keys, counts): what one chunk has in one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                grams, _, _ = gram_hashes(_texts(batch.column("sizes")[r].as_py(), batch.column("texts")[r].as_py()))
                hashes, counts, by, heads = _dealt(grams, parts)
                key, counts = _split(hashes[by], parts)[1], counts[by]
                held = np.nonzero(np.diff(heads))[0]
                cut = [(key[heads[p]:heads[p + 1]], counts[heads[p]:heads[p + 1]]) for p in held]
                chunk = batch.column("chunk")[r].as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.array(held), pa.array(np.full(len(held), chunk)), pa.array([_pack_keys(k) for k, _ in cut], pa.binary()),
                    pa.array([_pack(c, 4) for _, c in cut], pa.binary())], ["part", "chunk", "keys", "counts"])

    return table.select("chunk", "sizes", "texts").mapInArrow(run, "part long, chunk long, keys binary, counts binary")


def _counted(table: pa.Table) -> pa.Table:
    """Count table of a partition, joined to each chunk's rows: a total for each of its
    keys in their order, zero for those that occur once."""
    rows = [(c, _unpack_keys(k), _unpack(n, 4)) for c, k, n in zip(
        table.column("chunk").to_pylist(), table.column("keys").to_pylist(), table.column("counts").to_pylist())]
    keys = np.concatenate([k for _, k, _ in rows])
    by = np.argsort(keys, kind="stable")
    heads = np.concatenate(([0], np.nonzero(np.diff(keys[by]))[0] + 1))
    totals = np.add.reduceat(np.concatenate([n for _, _, n in rows])[by], heads)
    table_keys, table_n = keys[by][heads][totals > 1], totals[totals > 1]
    out = []
    for chunk, key, _ in rows:
        at = np.minimum(np.searchsorted(table_keys, key), max(0, len(table_keys) - 1))
        there = table_keys[at] == key if len(table_keys) else np.zeros(len(key), bool)
        total = np.zeros(len(key), np.uint64)
        total[there] = table_n[at[there]]
        out.append((chunk, _pack_totals(total)))
    part = table.column("part")[0].as_py()
    return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()), "part": pa.array([part] * len(out), pa.int64()),
                     "totals": pa.array([n for _, n in out], pa.binary())})


def backoff(grams: list[np.ndarray], doc: np.ndarray, place: np.ndarray, n_docs: int, totals: list[np.ndarray], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(log score, words) of each document, from the corpus counts of its n-grams."""
    sizes = np.bincount(doc, minlength=n_docs)
    left = []
    for hashes, total in zip(grams, totals):
        _, inverse = np.unique(hashes, return_inverse=True)
        _, inverse, own = np.unique(doc * np.int64(len(hashes) + 1) + inverse, return_inverse=True, return_counts=True)
        left.append(np.where(hashes > 0, np.maximum(total - own[inverse], 0), 0).astype(np.float64))
    words = (n_words - sizes[doc]).astype(np.float64)
    longest = np.minimum(place + 1, ORDER)
    log = longest * math.log(ALPHA) - np.log(words + 1)
    for k in range(1, ORDER + 1):
        there = left[k - 1] > 0
        below = words if k == 1 else np.concatenate(([1.0], left[k - 2][:-1]))
        log[there] = (longest[there] - k) * math.log(ALPHA) + np.log(left[k - 1][there] / below[there])
    return np.bincount(doc, log, n_docs), sizes


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, log_score, mean_log) for every row of docs.

    Null text is empty; a text without words has a log score of zero and no mean.  Rows
    that repeat an id, and null ids, are documents of their own.  Further columns are
    not read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    table = settled(chunks(docs, id_col, text_col), "chunks")
    kind = table.schema["ids"].dataType.elementType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(t) for r in range(batch.num_rows) for t in _texts(
                batch.column(0)[r].as_py(), batch.column(1)[r].as_py()))], pa.int64())], ["n"])

    n_words = table.select("sizes", "texts").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    parts = int(min(MOST_PARTS, max(1, ORDER * n_words // PART_GRAMS)))
    reducers = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = _exploded(table, parts).repartition(min(parts, 8 * reducers), "part").groupBy("part").applyInArrow(
        _counted, "chunk long, part long, totals binary")
    # written, so that the shuffled n-grams can go before texts and replies meet
    replies = settled(found, "counts").groupBy("chunk").agg(F.collect_list(F.struct("part", "totals")).alias("replies"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                texts = _texts(batch.column("sizes")[r].as_py(), batch.column("texts")[r].as_py())
                grams, doc, place = gram_hashes(texts)
                got = sorted(batch.column("replies")[r].as_py() or [], key=lambda x: x["part"])
                # the totals come in the order in which this chunk's n-grams were dealt
                hashes, _, by, _ = _dealt(grams, parts)
                known = np.zeros(len(hashes), np.int64)
                if got:
                    known[by] = np.concatenate([_unpack_totals(x["totals"]) for x in got])
                totals = [np.where(g > 0, known[np.searchsorted(hashes, np.maximum(g, hashes[0]))], 0) if len(hashes) else np.zeros(len(g), np.int64)
                          for g in grams]
                log, sizes = backoff(grams, doc, place, len(texts), totals, n_words)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[r].values, pa.array(sizes.astype(np.int64)), pa.array(log)], ["id", "n_words", "log_score"])

    scored = table.join(replies, "chunk", "left").select("ids", "sizes", "texts", "replies").mapInArrow(score, f"id {kind}, n_words long, log_score double")
    return scored.select(F.col("id").alias(id_col), "n_words", "log_score",
                         F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scores.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log", 6).alias("mean_log"))


OP4_SQL = """
WITH w AS (
  SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
g AS (
  SELECT doc_id, i, w, lag(w) OVER d AS w1, lag(w, 2) OVER d AS w2 FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
size AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
total AS (SELECT count(*) AS n FROM w),
c AS (
  SELECT doc_id, i,
    count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
    CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY w1, w) - count(*) OVER (PARTITION BY doc_id, w1, w) ELSE 0 END AS c2,
    CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY w2, w1, w) - count(*) OVER (PARTITION BY doc_id, w2, w1, w) ELSE 0 END AS c3
  FROM g),
b AS (
  SELECT *, lag(c1) OVER d AS b1, lag(c2) OVER d AS b2, least(i, 3) AS k FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
s AS (
  SELECT b.doc_id, CASE
    WHEN c3 > 0 THEN ln(c3 / b2)
    WHEN c2 > 0 THEN (k - 2) * ln(0.4) + ln(c2 / b1)
    WHEN c1 > 0 THEN (k - 1) * ln(0.4) + ln(c1 / (total.n - size.n))
    ELSE k * ln(0.4) - ln(total.n - size.n + 1) END AS l
  FROM b JOIN size USING (doc_id), total)
SELECT d.doc_id, coalesce(x.n, 0) AS n_words, round(coalesce(x.l, 0), 4) AS log_score, round(x.l / x.n, 6) AS mean_log
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(l) AS l FROM s GROUP BY doc_id) x USING (doc_id)
"""
