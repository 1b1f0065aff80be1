"""Benchmark decontamination by a BM25 index of the test items (operator 2).

The items are indexed in units of at most UNIT words; a posting's impact is its BM25
weight over the unit's score for itself, so a passage that holds a whole unit scores
one.  Postings lie in blocks of BLOCK units (units in order of length, so that the
bound of a block is tight) with the largest impact of a term in each.

Every passage of PASSAGE words, half overlapping, of every training document is a
query.  First, for all passages of a batch at once, a block's bound is the sum of
its terms' block maxima; blocks under the threshold are skipped.  In what is left,
block-max WAND runs document at a time: lists are ordered by their current unit, the
pivot is where the term maxima reach the threshold, the block maxima are checked
before a unit is scored, and a block that fails is skipped whole.  All units above
the threshold are retrieved.  A document is contaminated by an item if the item's
word shingles occur in it: a share of SIMILARITY of the question's and of the
answer's, where the last sentence is the answer.

The index is a bounded broadcast: SHARD items at most.  More items are split by a
hash of their ids into shards that are asked one after another; every shard, a random
part, has its own document frequencies.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracefp.llm.store import fresh

UNIT, PASSAGE, BLOCK = 64, 128, 8
SHARD = 20_000
SHINGLE, SIMILARITY, THRESHOLD = 5, 0.8, 0.6
K1, B = 1.2, 0.75
BATCH_WORDS = 400_000

_SPACES = bytes(32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits; everything beyond ASCII belongs to words."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()


def question_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Words of all sentences but the last, and of the last; one sentence is a question."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if words_of(p)]
    if len(parts) < 2:
        return words_of(text), []
    return [w for p in parts[:-1] for w in words_of(p)], words_of(parts[-1])


def shingles(words: list[bytes]) -> set[bytes]:
    n = min(SHINGLE, len(words))
    return {b" ".join(words[k:k + n]) for k in range(len(words) - n + 1)} if words else set()


class _Terms(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class Index:
    """Inverted index of the items (id, text) of a shard."""

    def __init__(self, items: list[tuple[object, str | None]]) -> None:
        self.items = [(i, *question_answer(t)) for i, t in items]
        units = []
        for n, (_, q, a) in enumerate(self.items):
            words = q + a
            size = -(-len(words) // max(1, -(-len(words) // UNIT))) if words else 1
            units += [(n, words[k:k + size]) for k in range(0, len(words), size)]
        units.sort(key=lambda u: len(u[1]))
        self.unit_item = [n for n, _ in units]
        self.terms = _Terms()
        mean = sum(len(w) for _, w in units) / max(1, len(units))
        frequency = Counter(w for _, words in units for w in set(words))
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for u, (_, words) in enumerate(units):
            weight = {}
            for w, tf in Counter(words).items():
                idf = math.log(1 + (len(units) - frequency[w] + 0.5) / (frequency[w] + 0.5))
                weight[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            own = sum(weight.values())
            for w, x in weight.items():
                if w not in self.terms:
                    self.terms[w] = len(self.terms)
                postings[self.terms[w]].append((u, x / own))
        self.units = [[u for u, _ in postings[t]] for t in range(len(self.terms))]
        self.impacts = [[x for _, x in postings[t]] for t in range(len(self.terms))]
        self.most = [max(x) for x in self.impacts]
        self.block_most: list[dict[int, float]] = []
        for us, xs in zip(self.units, self.impacts):
            best: dict[int, float] = {}
            for u, x in zip(us, xs):
                best[u // BLOCK] = max(best.get(u // BLOCK, 0.0), x)
            self.block_most.append(best)
        self.n_blocks = -(-len(units) // BLOCK)
        # flat copy of the block maxima for the bounds of many passages at once
        sizes = np.array([len(x) for x in self.block_most], np.int64)
        self.block_sizes, self.block_starts = sizes, np.cumsum(sizes) - sizes
        self.blocks = np.array([b for x in self.block_most for b in x], np.int64)
        self.maxima = np.array([v for x in self.block_most for v in x.values()])
        self.sets = [(shingles(q), shingles(a)) for _, q, a in self.items]

    def wand(self, terms: list[int], blocks: set[int], threshold: float) -> list[tuple[int, float]]:
        """(unit, score) of all units of the given blocks that score the threshold or more."""
        found, at = [], {t: 0 for t in terms}
        wanted = sorted(blocks)

        def seek(t: int, unit: int) -> None:
            """To the list's first unit from ``unit`` on, over blocks that are out."""
            us, k = self.units[t], at[t]
            while k < len(us) and (us[k] < unit or us[k] // BLOCK not in blocks):
                k += 1
            at[t] = k

        for t in terms:
            seek(t, wanted[0] * BLOCK if wanted else 0)
        while True:
            lists = sorted((self.units[t][at[t]], t) for t in terms if at[t] < len(self.units[t]))
            bound, pivot = 0.0, None
            for k, (u, t) in enumerate(lists):
                bound += self.most[t]
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot is None:
                return found
            unit = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == unit:
                pivot += 1
            block = unit // BLOCK
            ahead = lists[:pivot + 1]
            if sum(self.block_most[t].get(block, 0.0) for _, t in ahead) < threshold - 1e-9:
                # no unit of this block before the next list's own can reach the threshold
                to = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][0])
                for _, t in ahead:
                    seek(t, max(to, unit + 1))
            elif lists[0][0] == unit:
                score = sum(self.impacts[t][at[t]] for _, t in ahead)
                if score >= threshold - 1e-9:
                    found.append((unit, score))
                for _, t in ahead:
                    seek(t, unit + 1)
            else:
                for u, t in ahead:
                    if u < unit:
                        seek(t, unit)

    def retrieve(self, ids: np.ndarray, counts: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """(document, item, score) over all passages of documents laid end to end."""
        if not self.n_blocks or not len(ids):
            return
        step = PASSAGE // 2
        per = np.maximum(1, -(-(counts - PASSAGE) // step) + 1) * (counts > 0)
        doc = np.repeat(np.arange(len(counts)), per)
        known = np.nonzero(ids >= 0)[0]
        # passages of a word: of its document, at two neighbouring steps
        word_doc = np.repeat(np.arange(len(counts)), counts)[known]
        nth = (known - (np.cumsum(counts) - counts)[word_doc]) // step
        head = (np.cumsum(per) - per)[word_doc]
        passage = np.concatenate((head + np.minimum(nth, per[word_doc] - 1), head + np.minimum(np.maximum(nth - 1, 0), per[word_doc] - 1)))
        term = np.concatenate((ids[known], ids[known])).astype(np.int64)
        pairs = np.unique(passage * len(self.terms) + term)
        passage, term = pairs // len(self.terms), pairs % len(self.terms)
        # a passage whose terms' maxima cannot reach the threshold is out
        reach = np.bincount(passage, np.array(self.most)[term], len(doc))
        stay = reach[passage] >= threshold - 1e-9
        passage, term = passage[stay], term[stay]
        sizes = self.block_sizes[term]
        ends = np.cumsum(sizes)
        if not len(ends):
            return
        at = np.arange(ends[-1]) + np.repeat(self.block_starts[term] - (ends - sizes), sizes)
        cell = np.repeat(passage, sizes) * self.n_blocks + self.blocks[at]
        cells, where = np.unique(cell, return_inverse=True)
        hot = cells[np.bincount(where, self.maxima[at]) >= threshold - 1e-9]
        heads = np.searchsorted(passage, np.arange(len(doc) + 1))
        for p in np.unique(hot // self.n_blocks):
            lo, hi = np.searchsorted(hot, [p * self.n_blocks, (p + 1) * self.n_blocks])
            terms = term[heads[p]:heads[p + 1]].tolist()
            for unit, score in self.wand(terms, set((hot[lo:hi] % self.n_blocks).tolist()), threshold):
                yield int(doc[p]), self.unit_item[unit], score

    def overlaps(self, words: list[bytes], item: int) -> tuple[float, float]:
        """Shares of the question's and of the answer's shingles that the words hold; a
        missing part is held."""
        shares = []
        for part in self.sets[item]:
            if not part:
                shares.append(1.0)
                continue
            n = len(next(iter(part)).split(b" "))
            there = {b" ".join(words[k:k + n]) for k in range(len(words) - n + 1)}
            shares.append(len(part & there) / len(part))
        return shares[0], shares[1]

    def search(self, texts: list[str | None], threshold: float) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, score, question share, answer share) of verified items."""
        part: list[list[bytes]] = []
        start = total = 0
        for n, text in enumerate(texts):
            part.append(words_of(text))
            total += len(part[-1])
            if total >= BATCH_WORDS or n == len(texts) - 1:
                ids = np.fromiter(map(self.terms.__getitem__, (w for x in part for w in x)), np.int64, total)
                best: dict[tuple[int, int], float] = {}
                for doc, item, score in self.retrieve(ids, np.array([len(x) for x in part], np.int64), threshold):
                    best[doc, item] = max(best.get((doc, item), 0.0), score)
                for (doc, item), score in sorted(best.items()):
                    q, a = self.overlaps(part[doc], item)
                    if q >= SIMILARITY and a >= SIMILARITY:
                        yield start + doc, item, score, q, a
                part, start, total = [], n + 1, 0


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, item_col, score, question_overlap, answer_overlap) for every document and
    item found in it.

    Items without words, null or empty, match nothing; null text is empty.  Rows that
    repeat an id give their own rows, equal rows once each; items that repeat an id are
    items of their own.  Further columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).cast("string").alias("text"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type, item_type = dict(rows.dtypes)["id"], items.schema["id"].dataType
    kind = to_arrow_type(item_type)
    shards = max(1, -(-items.count() // SHARD))
    found = None
    for shard in range(shards):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == shard)
        shared = spark.sparkContext.broadcast(Index([tuple(r) for r in part.collect()]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                hits = list(index.search(batch.column(1).to_pylist(), threshold))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([h[0] for h in hits], pa.int64())),
                    pa.array([index.items[h[1]][0] for h in hits], kind),
                    *[pa.array([h[k] for h in hits], pa.float64()) for k in (2, 3, 4)]],
                    ["id", "item", "score", "question_overlap", "answer_overlap"])

        hits = rows.mapInArrow(run, f"id {id_type}, item {item_type.simpleString()}, score double, question_overlap double, answer_overlap double")
        found = hits if found is None else found.unionByName(hits)
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows whose id is among the contaminated ones; null ids stay."""
    mark = fresh(docs, "gone")
    gone = contaminated(docs, benchmark, id_col, text_col, item_col, item_text_col).select(F.col(id_col).alias(mark)).distinct()
    return docs.join(gone, docs[id_col] == F.col(mark), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
