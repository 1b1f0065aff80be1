"""Secret scans whose false positives a random forest removes (operator 10).

A candidate is a run of twelve or more characters of keys and tokens with a digit in
it.  What the forest sees of it: its length, the shares of its kinds of characters and
the transitions between them, its entropy, how much of it the corpus' own words cover,
its path, and the words on either side.  The forest is Spark ML's, trained on at most
SAMPLE labelled findings of each class, chosen by a hash; the dictionary is the
DICTIONARY most frequent words, counted over all documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefp.llm.store import settled

CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{12,}={0,2}")
DIGIT = re.compile(r"\d")
NAME = re.compile(r"([A-Za-z][A-Za-z0-9_.\-]{1,40})\s*(?:=|:|=>)\s*[\"']?$")
NEAR = 60
SAMPLE = 10_000
DICTIONARY = 20_000
WORD_LENGTHS = (4, 12)
NEIGHBOURS, PATHS = 32, 8
TREES, DEPTH, SEED = 40, 8, 17
THRESHOLD = 0.5

# Names that keys are given to, and public key formats.
KEY_NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "private_key")
KEY_FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})$"


def dictionary(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The most frequent words of letters, ties in order; DICTIONARY bounds what is kept."""
    low, high = WORD_LENGTHS
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col).cast("string")), r"[^\p{L}]+")).alias("w")).where(
        (F.length("w") >= low) & (F.length("w") <= high))
    return [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(DICTIONARY).collect()]


def coverage(text: str, words: frozenset[str]) -> float:
    """Share of the characters in the longest dictionary words, from the left."""
    text, at, covered = text.lower(), 0, 0
    low, high = WORD_LENGTHS
    while at < len(text):
        n = next((n for n in range(min(high, len(text) - at), low - 1, -1) if text[at:at + n] in words), 0)
        covered += n
        at += n or 1
    return covered / max(1, len(text))


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(value: str, before: str, after: str, path: str | None, words: frozenset[str]) -> list[float]:
    kinds = [_kind(c) for c in value]
    shares, pairs = Counter(kinds), Counter(zip(kinds, kinds[1:]))
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    out = [float(n), entropy, coverage(value, words), len(set(value)) / n, float(all(c in "0123456789abcdefABCDEF" for c in value))]
    out += [shares[k] / n for k in range(4)] + [pairs[a, b] / max(1, n - 1) for a in range(4) for b in range(4)]
    name = NAME.search(before)
    low = name[1].lower() if name else ""
    out += [float(bool(name)), float(any(k in low for k in KEY_NAMES)), float(before[-1:] in "\"'"), float(after[:1] in "\"'")]
    near = [0.0] * NEIGHBOURS
    for w in re.findall(r"\w+", before.lower())[-3:] + re.findall(r"\w+", after.lower())[:3]:
        near[zlib.crc32(w.encode()) % NEIGHBOURS] += 1
    places = [0.0] * PATHS
    for w in re.findall(r"[A-Za-z]+", path or "")[-4:]:
        places[zlib.crc32(w.lower().encode()) % PATHS] += 1
    return out + near + places + [float((path or "").count("/"))]


def candidates(docs: DataFrame, words: list[str], id_col: str = "doc_id", path_col: str | None = "source", text_col: str = "text") -> DataFrame:
    """(id, begin, value, before, after, features) for every candidate of every row."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for n, (path, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for m in CANDIDATE.finditer(text or ""):
                    if DIGIT.search(m[0]):
                        before, after = text[max(0, m.start() - NEAR):m.start()], text[m.end():m.end() + NEAR]
                        at.append(n)
                        found.append((m.start(), m[0], before, after, features(m[0], before, after, path, shared.value)))
            cols = list(zip(*found)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(
                cols, (pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64())))]], ["id", "begin", "value", "before", "after", "features"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, begin int, value string, before string, after string, features array<double>")


def known_labels(value: Column, before: Column) -> Column:
    """Labels that formats settle: 1 for a public key format or a value given to a key
    name, 0 for digits alone and for values of no mixture, else null."""
    named = before.rlike(r"(?i)(" + "|".join(KEY_NAMES) + r")[\"']?\s*(=|:)\s*[\"']?$")
    return F.when(value.rlike(KEY_FORMATS) | named, 1).when(value.rlike(r"^\d+$|^[A-Za-z]+[-_/]?\d{1,4}$|^[\d/_-]+$|^(.)\1*$"), 0)


def train_forest(findings: DataFrame) -> RandomForestClassificationModel | float:
    """Forest from labelled findings (features, label); the share of label 1 where either
    class is missing.  The sample is put in order in one bounded partition, so that the
    same findings give the same forest."""
    findings = findings.where("label IS NOT NULL AND features IS NOT NULL").select(F.col("label").cast("double").alias("label"), "features", F.xxhash64("features").alias("h"))
    sample = [findings.where(F.col("label") == y).orderBy("h").limit(SAMPLE) for y in (0, 1)]
    counts = [s.count() for s in sample]
    if not min(counts):
        return 1.0 if counts[1] else 0.0
    rows = sample[0].unionByName(sample[1]).coalesce(1).sortWithinPartitions("label", "h").select("label", array_to_vector("features").alias("x"))
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(rows)


def judged(found: DataFrame, model: RandomForestClassificationModel | float) -> DataFrame:
    """found with score, the forest's share for a secret."""
    if isinstance(model, float):
        return found.withColumn("score", F.lit(model))
    return model.transform(found.withColumn("x", array_to_vector("features"))).withColumn("score", vector_to_array("probability")[1]).drop(
        "x", "rawPrediction", "probability", "prediction")


def scan_secrets(docs: DataFrame, found: DataFrame, model: RandomForestClassificationModel | float, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_candidates, secrets) for every different id of docs; secrets holds
    (begin, length, score) of what stays, in order.

    Null and empty texts have no candidates.  Rows that repeat an id are put together; a
    null id is one id.  Other columns are not read; an empty table gives an empty table.
    """
    kept = judged(found, model)
    spot = F.struct("begin", F.length("value").alias("length"), F.round("score", 6).alias("score"))
    by_doc = kept.groupBy("id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("score") >= THRESHOLD, spot))).alias("secrets"))
    ids = docs.select(F.col(id_col).alias("_doc")).distinct()
    joined = ids.join(by_doc, F.col("_doc").eqNullSafe(F.col("id")), "left")
    return joined.select(F.col("_doc").alias(id_col), F.coalesce("n", F.lit(0)).alias("n_candidates"),
                         F.coalesce("secrets", F.array().cast(by_doc.schema["secrets"].dataType)).alias("secrets"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on candidates whose format settles the label, of documents with
    crc32(doc_id) mod 4 other than 2; all candidates of all documents are judged."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    found = settled(candidates(docs, dictionary(docs)), "candidates")
    learned = found.where(F.crc32(F.col("id").cast("string")) % 4 != 2).withColumn("label", known_labels(F.col("value"), F.col("before")))
    scanned = scan_secrets(docs, found, train_forest(learned))
    return scanned.select("doc_id", "n_candidates", F.size("secrets").alias("n_secrets"), "secrets")
