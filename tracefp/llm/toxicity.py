"""Toxicity of whole texts by a recurrent network over overlapping windows (operator 8).

Every window of WINDOW words, SHIFT words apart, is scored by the network of
``gru.py``; what a document's windows say (the highest logit, the mean of the two
highest, the mean and the sum of their probabilities, their number) goes into a
logistic unit fitted on training documents that the network has not seen.

Labels are learned from rows whose crc32(id as text) mod 4 is not 2, from at most
SAMPLE documents of each class, chosen by a hash of the id; the network takes a
fixed number of steps, so fitting costs the same at every size.  All other work
covers all documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefp.llm import gru
from tracefp.llm.store import kept_in_worker

WINDOW, SHIFT = 64, 48
SAMPLE = 1000
SAMPLE_CHARS, PIECES = 40_000, 50
STEPS, BATCH = 240, 256
SEED = 11
CACHE_WORDS = 120_000
CHUNK_WORDS = 120_000
THRESHOLD = 0.3


def held_out(id_col: Column) -> Column:
    """Rows whose labels may not be learned from; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs without white space; longer ones in pieces of WORD_BYTES bytes."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if words and max(map(len, words)) > gru.WORD_BYTES:
        words = [w[k:k + gru.WORD_BYTES] for w in words for k in range(0, len(w), gru.WORD_BYTES)]
    return words


def window_table(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, text) of the windows of texts laid end to end."""
    per_text = np.maximum(1, -(-(counts - WINDOW) // SHIFT) + 1) * (counts > 0)
    text = np.repeat(np.arange(len(counts)), per_text)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    starts = np.cumsum(counts) - counts
    return starts[text] + nth * SHIFT, np.minimum(WINDOW, counts[text] - nth * SHIFT), text


def summary(logit: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """One row per text of what its windows say; texts without words get zeros."""
    out = np.zeros((n_texts, 6))
    if len(text):
        by = np.lexsort((-logit, text))
        heads = np.concatenate(([0], np.nonzero(np.diff(text[by]))[0] + 1))
        sizes = np.diff(np.concatenate((heads, [len(by)])))
        ranked = logit[by].astype(np.float64)
        prob = 1 / (1 + np.exp(-ranked))
        total = np.add.reduceat(prob, heads)
        second = ranked[heads + (sizes > 1)]
        out[text[by][heads]] = np.stack([ranked[heads], (ranked[heads] + second) / 2, total / sizes, np.log1p(total), np.log(sizes), np.ones(len(heads))], 1)
    return out


class Scorer:
    """A fitted network with a bounded cache of the words it has met."""

    def __init__(self, model: dict) -> None:
        self.model, self.index, self.gates = model, {}, np.zeros((0, 2, 3 * gru.HIDDEN), np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability for each text; one without words gets the share of toxic
        training documents."""
        if "network" not in self.model:
            return np.full(len(texts), self.model["prior"])
        out = np.empty(len(texts))
        part, at, total = [], 0, 0
        for n, text in enumerate(texts):
            part.append(words_of(text))
            total += len(part[-1])
            if total >= CHUNK_WORDS or n == len(texts) - 1:
                out[at:n + 1] = self._part(part)
                part, at, total = [], n + 1, 0
        return out

    def _part(self, texts: list[list[bytes]]) -> np.ndarray:
        rows = summary(*self.windows(texts), len(texts))
        empty = rows[:, -1] == 0
        z = (rows - self.model["shift"]) @ self.model["slope"]
        return np.where(empty, self.model["prior"], 1 / (1 + np.exp(-np.clip(z, -50, 50))))

    def windows(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(logit, text) of every window."""
        p = self.model["network"]
        met = dict.fromkeys(w for x in texts for w in x)
        new = [w for w in met if w not in self.index]
        if len(self.index) + len(new) > CACHE_WORDS:
            self.index, new = {}, list(met)
        index, at = self.index, len(self.index)
        if at + len(new) > len(self.gates):
            # room for a full cache is taken once; only texts of more words than that take more
            kept, self.gates = self.gates[:at], np.empty((max(CACHE_WORDS, at + len(new)), *self.gates.shape[1:]), np.float32)
            self.gates[:at] = kept
        index.update(zip(new, range(at, at + len(new))))
        for k in range(0, len(new), 8192):
            part = new[k:k + 8192]
            self.gates[at + k:at + k + len(part)] = gru.project(p, gru.embed(p, *gru.features(part)))
        flat = np.fromiter((index[w] for x in texts for w in x), np.int64)
        first, size, text = window_table(np.array([len(x) for x in texts], np.int64))
        logit = np.empty(len(first), np.float32)
        for k in range(0, len(first), 2048):
            a, n = first[k:k + 2048], size[k:k + 2048]
            order = flat[np.minimum(a[:, None] + np.arange(n.max()), len(flat) - 1)]
            logit[k:k + 2048] = gru.logits(p, self.gates, order, n)
        return logit, text


def fit(texts: list[str | None], labels: np.ndarray) -> dict:
    """Network and logistic unit from labelled texts; only the prior where either class
    has under eight texts with words."""
    texts = [words_of(t) for t in texts]
    has = np.array([len(t) > 0 for t in texts], bool)
    prior = float(labels.mean()) if len(labels) else 0.0
    if min((labels[has] == 0).sum(), (labels[has] == 1).sum()) < 8:
        return {"prior": prior}
    texts, labels = [t for t, h in zip(texts, has) if h], labels[has]
    known = {w: n for n, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    ids, weights = gru.features(list(known))
    flat = np.fromiter((known[w] for t in texts for w in t), np.int64)
    first, size, text = window_table(np.array([len(t) for t in texts], np.int64))
    windows = flat.astype(np.int32)[np.minimum(first[:, None] + np.arange(WINDOW), len(flat) - 1)]
    # every fourth text of each class is kept for the logistic unit
    rank = np.zeros(len(labels), np.int64)
    for y in (0, 1):
        rank[labels == y] = np.arange((labels == y).sum())
    learn = rank % 4 != 3
    own = learn[text]
    network = gru.train(ids, weights, windows[own], size[own], labels[text[own]], STEPS, BATCH, SEED)
    rest = np.nonzero(~learn)[0]
    rows = summary(*Scorer({"network": network}).windows([texts[i] for i in rest]), len(rest))
    shift = rows.mean(0) * np.array([1, 1, 1, 1, 1, 0])
    return {"network": network, "prior": prior, "shift": shift, "slope": _logistic(rows - shift, labels[rest])}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - y) + ridge * beta
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(beta)), grad)
        beta -= np.clip(step, -2, 2)
    return beta


def spread(text: Column, chars: int = SAMPLE_CHARS, pieces: int = PIECES) -> Column:
    """A text of up to ``chars`` characters whole; of a longer one ``pieces`` pieces of equal
    length, evenly spaced from its first character to its last, ``chars`` in all."""
    size = chars // pieces
    room = F.length(text).cast("long") - size
    parts = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)),
                        lambda i: F.substring(text, (F.floor(i * room / max(pieces - 1, 1)) + 1).cast("int"), F.lit(size)))
    return F.when(text.isNull() | (F.length(text) <= chars), text).otherwise(F.array_join(parts, " "))


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Model from the labelled rows that are not held out; an id with several labels
    counts as toxic if one of them is.  SAMPLE documents a class and SAMPLE_CHARS
    characters of each, drawn over its whole text, bound what reaches the driver;
    scoring has no such bound."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(
        F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = marked.where("y = 1").orderBy(*order).limit(SAMPLE).unionByName(marked.where("y = 0").orderBy(*order).limit(SAMPLE))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text"))
    got = rows.select("id", "y", spread(F.col("text")).alias("text")).toPandas().sort_values("id")
    total = marked.agg(F.avg("y")).first()[0] or 0.0
    model = fit(got["text"].tolist(), got["y"].to_numpy(np.int64))
    if "slope" in model:
        # the sample is balanced by class; odds go back to the share among labelled rows
        share = float(got["y"].mean())
        model["slope"][-1] += np.log(max(total, 1e-6) / max(1 - total, 1e-6)) - np.log(share / (1 - share))
    return model | {"prior": float(total)}


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for every row of docs.

    Null and empty texts get the share of toxic training rows.  Repeated rows and null
    ids get a score each; no column but the text goes into a score; an empty table
    gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept_in_worker(key, lambda: Scorer(shared.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.score(batch.column(1).to_pylist()), pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text scores the threshold or more; texts without
    words stay, and every row is judged by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key, at = uuid.uuid4().hex, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept_in_worker(key, lambda: Scorer(shared.value))
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).to_pylist()
            has = np.array([bool(t and t.strip()) for t in texts], bool)
            yield batch.filter(pa.array(~has | (scorer.score(texts) < threshold)))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score_toxicity(docs, train_toxicity(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
