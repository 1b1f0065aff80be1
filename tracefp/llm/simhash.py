"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 1).

The 64 bits are cut into segments of 22, 21 and 21 bits.  Two fingerprints with at
most two differing bits have, for at least one of the cyclic segment pairs (X, Y),
no error in X and at most one in Y.  So each fingerprint files one key per pair, X
with the index of the Golay code word that Y decodes to, and asks under up to six,
X with each code word near Y.  Equal keys give candidates, exact distance decides.

Equal fingerprints are collapsed first.  A key under which more than ``bucket``
fingerprints meet (a family of near copies) is not paired: its fingerprints list
the 64 strings one bit away and themselves, and two of them are within two bits
exactly if they list a string in common.  That is 65 rows each, whatever the size
of the family, and no link is lost.

The query and the pipeline's stage both group by that rule.  The stage also joins
documents of Jaccard similarity 0.8 in shingles of five words, at which fingerprints
differ in too many bits for keys like these: it files BANDS keys of ROWS minimum hashes
each, under one of which 0.9998 of the pairs at J = 0.8 meet, and verifies every
candidate by the exact similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefp.llm import golay
from tracefp.llm.components import components
from tracefp.llm.crowds import crowd_links
from tracefp.llm.lines import _met
from tracefp.llm.store import fresh, settled
from tracefp.session import materialize

SHINGLE_BLOCK = 1 << 15
SEGMENTS = ((0, 22), (22, 21), (43, 21))
BANDS, ROWS, HASH_BLOCK = 16, 4, 1 << 12
MULTIPLIERS, OFFSETS = np.random.default_rng(23).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64, False) | np.uint64(1)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash: a bit is 1 if set in over half the hashes of the shingles.

    A-Z are lower-cased, words are runs without ASCII white space, shingles count as
    often as they occur.  Fewer words than a shingle: the whole sequence is one; no
    words, or null: zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    begin, end = starts[: len(words) - size + 1].tolist(), ends[size - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(begin), SHINGLE_BLOCK):
        hashes = np.array([digest(joined[x:y], 42) for x, y in zip(begin[at:at + SHINGLE_BLOCK], end[at:at + SHINGLE_BLOCK])], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begin), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp long) for every row, null ids included."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fp long").withColumnRenamed("id", id_col)


def _keys(fps: DataFrame) -> DataFrame:
    """(key, files, fp, rep): under which keys a fingerprint is filed and asked for."""
    kind = dict(fps.dtypes)["rep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            seg = [(fp.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << n) - 1) for at, n in SEGMENTS]
            key, files, row = [], [], []
            for pair in range(3):
                x, y = seg[pair], seg[(pair + 1) % 3]
                base = (x << 14) + pair
                key.append(base + (golay.own_index(y) << 2))
                files.append(np.ones(len(fp), bool))
                row.append(np.arange(len(fp)))
                near = golay.near_indices(y)
                r, c = np.nonzero(near >= 0)
                key.append(base[r] + (near[r, c] << 2))
                files.append(np.zeros(len(r), bool))
                row.append(r)
            take = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), pa.array(np.concatenate(files)),
                                              batch.column(0).take(take), batch.column(1).take(take)], ["key", "files", "fp", "rep"])

    return fps.select("fp", "rep").mapInArrow(run, f"key long, files boolean, fp long, rep {kind}")


def _ball(fps: DataFrame) -> DataFrame:
    """(at, rep): each fingerprint and the 64 strings one bit away."""
    flips = F.array(F.lit(0).cast("long"), *[F.expr(f"shiftleft(1L, {b})") for b in range(64)])
    return fps.select("rep", "fp", F.explode(flips).alias("flip")).select("rep", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))


def near_links(fps: DataFrame, bucket: int = 64) -> DataFrame:
    """Links (a, b) between the reps of distinct fingerprints (fp, rep); their connected
    components are those of all pairs at two or fewer differing bits."""
    keys = _keys(fps)
    counts = keys.groupBy("key").agg(F.sum(F.col("files").cast("int")).alias("n"), F.count("*").alias("all"))
    crowded = counts.where((F.col("n") > 1) & (F.col("all") > bucket)).select("key")
    usual = counts.where((F.col("all") > 1) & (F.col("n") > 0) & ~((F.col("n") > 1) & (F.col("all") > bucket))).select("key")
    crowded, usual = (materialize(x, "keys") for x in (crowded, usual))
    met = keys.join(usual, "key", "left_semi")
    filed = met.where("files").select("key", F.col("fp").alias("fp_a"), F.col("rep").alias("a"))
    asked = met.where("NOT files").select("key", F.col("fp").alias("fp_b"), F.col("rep").alias("b"))
    pairs = filed.join(asked, "key").where("fp_a != fp_b AND bit_count(fp_a ^ fp_b) <= 2").select("a", "b")
    ball = _ball(keys.join(crowded, "key", "left_semi").select("fp", "rep").distinct())
    stars = ball.join(ball.groupBy("at").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1"), "at").select("a", F.col("rep").alias("b"))
    return pairs.unionByName(stars).where("a != b")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of docs: id_col, fp, component_id (the smallest id reachable by
    links of two or fewer differing bits, the row's own included).

    Null text is empty text, whose fingerprint zero links like any other.  Rows of
    equal id keep one row each.  A row without an id has no component and links
    nothing.  An empty table gives an empty table; further columns are not read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle).withColumnRenamed(id_col, "id"), "fingerprints")
    return _grouped(rows, near_links).withColumnRenamed("id", id_col)


def _grouped(rows: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows (id, fp) with component_id, by the links between the reps of (fp, rep)."""
    fps = materialize(rows.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep")), "fingerprints")
    ids = rows.where("id IS NOT NULL").join(fps, "fp")
    # an id whose rows have different texts joins their fingerprints
    several = ids.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a != z")
    bridges = several.join(ids, "id").select("a", F.col("rep").alias("b")).distinct()
    groups = components(links_of(fps).unionByName(bridges))
    labels = fps.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("label"))
    return rows.join(labels, "fp", "left").select(
        "id", "fp", F.when(F.col("id").isNotNull(), F.col("label")).alias("component_id"))


def word_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, keys: bool) -> DataFrame:
    """(id, fp, hashes) for every row: fp is a hash of the words, zero without words; hashes
    are those of the different shingles, or with ``keys`` their band keys.  Words
    and shingles are those of ``fingerprint``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    digest = xxhash.xxh64_intdigest

    def one(text: str | None) -> tuple[int, np.ndarray]:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return 0, np.zeros(0, np.int64)
        size = min(shingle, len(words))
        own = np.array(list({digest(b" ".join(words[k:k + size]), 42) for k in range(len(words) - size + 1)}), np.uint64)
        if keys:
            least = np.min([(own[k:k + HASH_BLOCK, None] * MULTIPLIERS + OFFSETS).min(0) for k in range(0, len(own), HASH_BLOCK)], 0)
            own = np.array([digest(least[k:k + ROWS].tobytes(), k) for k in range(0, len(least), ROWS)], np.uint64)
        return int(np.uint64(digest(b" ".join(words), 7)).astype(np.int64)), own.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                made = [one(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0] for m in made], pa.int64()),
                                                  pa.array([m[1] for m in made], pa.list_(pa.int64()))], ["id", "fp", "hashes"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fp long, hashes array<long>")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, crowd: int = 24) -> DataFrame:
    """As simhash_groups, but fp is a hash of the words, and links are those of Jaccard
    similarity ``similarity`` or more between the sets of word shingles.  Texts without
    words are equal.  In a band of more than ``crowd`` texts each is compared with
    few others, and ``crowd_links`` finds the links that are missing then."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settled(word_sets(docs, id_col, text_col, shingle, True), "keys")

    def links_of(fps: DataFrame) -> DataFrame:
        kinds = rows.join(fps.select("fp"), "fp").dropDuplicates(["fp"])
        pairs, crowded = _met(kinds.select(F.explode("hashes").alias("key"), F.col("fp").alias("line")), crowd, parts, True)
        pairs, crowded = settled(pairs, "pairs"), settled(crowded.withColumnRenamed("line", "fp"), "crowded")
        wanted = settled(pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).unionByName(crowded).distinct(), "wanted")
        ids = fps.join(wanted, "fp").select("rep").distinct()
        texts = docs.join(ids, docs[id_col] == ids["rep"], "left_semi")
        sets = word_sets(texts, id_col, text_col, shingle, False).join(wanted, "fp").dropDuplicates(["fp"])
        sets = settled(sets.select(F.col("fp").alias("node"), F.col("hashes").alias("set")), "sets")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        common = F.size(F.array_intersect("set_a", "set_b"))
        links = settled(both.where(common >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - common)).select("a", "b"), "links")
        if not crowded.isEmpty():
            links = links.unionByName(crowd_links(sets.join(crowded.withColumnRenamed("fp", "node"), "node", "left_semi"), links, similarity))
        # from texts to the ids that stand for them
        return links.join(fps.select(F.col("fp").alias("a"), F.col("rep").alias("rep_a")), "a").join(
            fps.select(F.col("fp").alias("b"), F.col("rep").alias("rep_b")), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))

    return _grouped(rows.select("id", "fp"), links_of).withColumnRenamed("id", id_col)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_col, component_id), one row per id: groups by the links of ``simhash_groups`` and
    those of ``similar_groups`` together; component_id is the smallest id reachable."""
    near = simhash_groups(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col("component_id").alias("a"))
    alike = similar_groups(docs, id_col, text_col, shingle, similarity).select(F.col(id_col).alias("id"), F.col("component_id").alias("b"))
    both = settled(near.where("id IS NOT NULL").distinct().join(alike.distinct(), "id"), "labels")
    # labels are smallest ids of their groups; a document in two groups joins them
    joined = components(both.where("a != b").select("a", "b").distinct()).withColumnRenamed("node", "b")
    return both.join(joined, "b", "left").select(F.col("id").alias(id_col), F.coalesce("component", "b").alias("component_id"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the rows that are not the first of their group of
    ``near_groups``; rows without an id
    stay, and of rows that repeat an id all stay or go."""
    groups = near_groups(docs, id_col, text_col, shingle, similarity)
    mark = fresh(docs, "gone")
    gone = groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(mark)).distinct()
    return docs.join(gone, docs[id_col] == F.col(mark), "left_anti")


def op1_simhash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
