"""Token ids in files of static range asymmetric numeral system blocks (operator 5).

One frequency table, counted over all ids, codes every block.  A block's ids are
dealt to LANES interleaved streams that take their steps side by side in numpy; a
lane's state lies in [2^31, 2^63) and gives or takes 32-bit words.  Every SEGMENT
steps the states and the place in the words are written as a checkpoint, so decoding
can begin at any of them; each block carries a checksum of its ids and of its bytes.
Blocks hold whole documents and stand alone: each is decoded by itself, anywhere.

The files are a table in the folder given: one row per block in ``blocks``, and the
frequencies in ``table``.  A lost executor costs the blocks it was at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracefp.llm.bpe import Units, chunks, default_tokenizer, tokenizer_spec
from tracefp.llm.store import kept_in_worker
from tracefp.session import shared_dir

SCALE = 20
LANES = 2048
SEGMENT = 128
BLOCK_IDS = 1 << 18
LOW = np.uint64(1 << 31)
END = 2


def scaled(counts: np.ndarray, total: int = 1 << SCALE) -> np.ndarray:
    """Frequencies that sum to total, at least one for every id, seen or not.

    Floors of the shares, what is left to the most frequent id."""
    if len(counts) > total // 2:
        raise ValueError("vocabulary too large for the table's precision")
    whole = max(1, int(counts.sum()))
    freq = np.maximum(1, counts.astype(object) * (total - len(counts)) // whole).astype(np.int64)
    freq[int(np.argmax(counts))] += total - int(freq.sum())
    return freq


class Coder:
    """Encoder and decoder of one frequency table."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
        self.limit = self.freq << np.uint64(31 - SCALE + 32)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """(words, states, places): 32-bit words in decoding order, states of all lanes at
        every checkpoint and the number of words read before it."""
        lanes = min(LANES, max(1, len(ids)))
        steps = -(-len(ids) // lanes)
        x = np.full(lanes, LOW, np.uint64)
        out: list[np.ndarray] = []
        states, places, n = [], [], 0
        for t in range(steps - 1, -1, -1):
            s = ids[t * lanes:(t + 1) * lanes]
            m = len(s)
            y, f = x[:m], self.freq[s]
            full = y >= self.limit[s]
            if full.any():
                out.append(y[full].astype(np.uint32))
                n += len(out[-1])
                y = np.where(full, y >> np.uint64(32), y)
            q = y // f
            x[:m] = (q << np.uint64(SCALE)) + (y - q * f) + self.start[s]
            if t % SEGMENT == 0:
                states.append(x.copy())
                places.append(n)
        words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        at = np.array([n - p for p in places[::-1]], np.int64)
        return words.astype("<u4").tobytes(), np.array(states[::-1], "<u8").tobytes(), at.astype("<i8").tobytes()

    def decode(self, n_ids: int, words: bytes, states: bytes, places: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids from checkpoint ``first`` up to checkpoint ``last`` (to the end if None)."""
        lanes = min(LANES, max(1, n_ids))
        steps = -(-n_ids // lanes)
        begin, end = first * SEGMENT, steps if last is None else min(steps, last * SEGMENT)
        if begin >= end:
            return np.zeros(0, np.int32)
        feed = np.frombuffer(words, "<u4").astype(np.uint64)
        x = np.frombuffer(states, "<u8").reshape(-1, lanes)[first].astype(np.uint64)
        at = int(np.frombuffer(places, "<i8")[first])
        out = np.empty(min(n_ids, end * lanes) - begin * lanes, np.int32)
        mask = np.uint64((1 << SCALE) - 1)
        for t in range(begin, end):
            m = min(lanes, n_ids - t * lanes)
            y = x[:m]
            slot = y & mask
            s = self.symbol[slot]
            y = self.freq[s] * (y >> np.uint64(SCALE)) + slot - self.start[s]
            low = np.nonzero(y < LOW)[0]
            y[low] = (y[low] << np.uint64(32)) | feed[at:at + len(low)]
            at += len(low)
            x[:m] = y
            out[(t - begin) * lanes:(t - begin) * lanes + m] = s
        return out


def checksum(*parts: bytes) -> int:
    value = 0
    for p in parts:
        value = zlib.crc32(p, value)
    return value


# new units that go through the library as one text
JOINED = 256


def _tokenizer(spec: str) -> Units:
    """The tokenizers library behind a bounded cache of the units that texts fall into."""
    from tokenizers import Tokenizer

    tool = Tokenizer.from_str(spec)
    tool.no_truncation()
    tool.no_padding()

    added = {t.content: i for i, t in tool.get_added_tokens_decoder().items()}
    # a byte-level token is spelled with one character a byte
    vocab = tool.get_vocab(with_added_tokens=False)
    bytes_of = np.zeros(max([*vocab.values(), *added.values()]) + 1, np.int64)
    bytes_of[list(vocab.values())] = [len(x) for x in vocab]
    joins = not any(c.isspace() for x in added for c in x)
    beside = re.compile(r"[ \n]\S(?:.*\S)?", re.S).fullmatch

    def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in tool.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(ids)), np.int32), np.array(list(map(len, ids)), np.int64)

    def run(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units that begin with a space or line end and end with neither go side by side in one
        text, which is cut again by the bytes of its tokens."""
        joined = [k for k, x in enumerate(units) if beside(x)] if joins else []
        texts = list(map("".join, batched([units[k] for k in joined], JOINED)))
        ids, _ = encoded(texts)
        ends = np.cumsum([len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass")) for x in (units[k] for k in joined)])
        reached = np.cumsum(bytes_of[ids])
        cuts = np.searchsorted(reached, ends) + 1
        if len(joined) and (reached[-1] != ends[-1] or (reached[cuts - 1] != ends).any()):
            return encoded(units)
        sizes = np.zeros(len(units), np.int64)
        sizes[joined] = np.diff(cuts, prepend=0)
        apart = np.ones(len(units), bool)
        apart[joined] = False
        rest, sizes[apart] = encoded([units[k] for k in np.nonzero(apart)[0]])
        flat = np.empty(int(sizes.sum()), np.int32)
        own = np.repeat(apart, sizes)
        flat[~own], flat[own] = ids, rest
        return flat, sizes

    return Units(run, added)


def token_blocks(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """(part, block, before, docs, counts, ids): documents in ascending order of id, then hash of
    the text, dealt to range partitions and there to blocks of about BLOCK_IDS ids,
    whole documents each; before is the number of ids before the block in its part.  ids are unsigned 32-bit little-endian with ``end`` after
    every document; null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_spec(path))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    kind = dict(rows.dtypes)["id"]
    dealt = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = kept_in_worker(f"tokenizer {hash(shared.value)}", lambda: _tokenizer(shared.value))
        part, block, before = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        counts: list[int] = []
        held: list[np.ndarray] = []
        total = 0
        typed = None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([before], pa.int64()), pa.array([keys], pa.list_(typed)), pa.array([counts], pa.list_(pa.int64())),
                pa.array([np.concatenate(held).astype("<u4").tobytes()], pa.binary())], ["part", "block", "before", "docs", "counts", "ids"])

        for batch in batches:
            typed, ids_of, texts = batch.column(0).type, batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                ids, n = units.encode(texts[a:b])
                # the end id goes behind every document
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, end)
                cuts = np.concatenate(([0], ends + np.arange(1, len(n) + 1))).tolist()
                for k in range(b - a):
                    keys.append(ids_of[a + k])
                    counts.append(cuts[k + 1] - cuts[k])
                    held.append(ids[cuts[k]:cuts[k + 1]])
                    total += counts[-1]
                    if total >= BLOCK_IDS:
                        yield flush()
                        keys, counts, held, total, block, before = [], [], [], 0, block + 1, before + total
        if keys:
            yield flush()

    return dealt.mapInArrow(run, f"part long, block long, before long, docs array<{kind}>, counts array<long>, ids binary")


def frequency_table(blocks: DataFrame, vocabulary: int) -> np.ndarray:
    """Counts of all ids; one row per id of the vocabulary reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for x in batch.column(0):
                counts += np.bincount(np.frombuffer(x.as_buffer(), "<u4"), minlength=vocabulary)
        seen = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["id", "n"])

    got = blocks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for r in got:
        counts[r["id"]] = r["n"]
    return counts


def write_tokens(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Token files of all documents in folder: ``table`` and ``blocks``."""
    import json

    spark = docs.sparkSession
    spec = json.loads(tokenizer_spec(path))
    vocabulary = max([*spec["model"]["vocab"].values(), *[t["id"] for t in spec.get("added_tokens", [])], END]) + 1
    token_blocks(docs, path, id_col, text_col).write.option("compression", "zstd").parquet(f"{folder}/ids")
    blocks = spark.read.parquet(f"{folder}/ids")
    freq = scaled(frequency_table(blocks, vocabulary))
    spark.createDataFrame([(freq.astype("<i4").tobytes(),)], "freq binary").write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            made = []
            for x in batch.column("ids"):
                ids = np.frombuffer(x.as_buffer(), "<u4")
                parts = coder.encode(ids)
                made.append((len(ids), *parts, checksum(x.as_buffer()), checksum(*parts)))
            cols = list(zip(*made)) if made else [[]] * 6
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in ("part", "block", "before", "docs", "counts")],
                *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))]],
                ["part", "block", "before", "docs", "counts", "n_ids", "words", "states", "places", "ids_crc32", "data_crc32"])

    kind = dict(blocks.dtypes)["docs"]
    blocks.mapInArrow(run, f"part long, block long, before long, docs {kind}, counts array<long>, n_ids long, words binary, states binary, places binary, "
                           "ids_crc32 long, data_crc32 long").write.option("compression", "none").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, ids): every document's ids from the files, unsigned 32-bit
    little-endian, and the number of ids before it.  A damaged block is an error."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    # one row per range partition of the writer, whose number is a setting: a bounded broadcast
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    freq = np.frombuffer(bytes(spark.read.parquet(f"{folder}/table").first()["freq"]), "<i4").astype(np.int64)
    shared = spark.sparkContext.broadcast(freq)
    kind = blocks.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for r in range(batch.num_rows):
                n, words, states, places, crc, data = (batch.column(c)[r].as_py() for c in ("n_ids", "words", "states", "places", "ids_crc32", "data_crc32"))
                if checksum(words, states, places) != data:
                    raise ValueError("token block with damaged data")
                raw = coder.decode(n, words, states, places).astype("<u4").tobytes()
                if checksum(raw) != crc:
                    raise ValueError("token block decodes to other ids than were written")
                counts = np.array(batch.column("counts")[r].as_py(), np.int64)
                ends = np.cumsum(counts)
                cuts = np.concatenate(([0], 4 * ends)).tolist()
                m = len(counts)
                yield pa.RecordBatch.from_arrays([
                    batch.column("docs")[r].values, pa.array(np.full(m, batch.column("part")[r].as_py())),
                    pa.array(batch.column("before")[r].as_py() + ends - counts), pa.array([raw[x:y] for x, y in zip(cuts, cuts[1:])], pa.binary())],
                    ["id", "part", "before", "ids"])

    decoded = blocks.mapInArrow(run, f"id {kind}, part long, before long, ids binary")
    return decoded.join(F.broadcast(parts), "part").select(F.col("id").alias(id_col), (F.col("base") + F.col("before")).alias("start"), "ids")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, default_tokenizer())
    return read_tokens(spark, folder).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
