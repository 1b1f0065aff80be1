"""Byte-level BPE encoding and decoding by a segment tree over pair ranks (operator 9).

The leaves of a word's tree hold the merge rank of every adjacent pair of symbols,
with its place; each inner node holds the least of its children.  So the root is the
leftmost pair of the lowest rank.  A merge changes three leaves (the pair itself, the
pair on its left, the pair it swallowed), and each point update walks up the tree.
The word is done when the root holds no rank.  Words of one tree size take their
steps side by side in numpy; the work of a word of n symbols is n log n, whatever
its length.  A bounded cache keeps words already encoded; it alters no result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefp.llm.store import kept_in_worker

NONE = np.int64(1) << np.int64(62)
CACHE_UNITS = 600_000
CHUNK_CHARS = 2_000_000
TREE_CELLS = 1 << 22

# Fixed value: the published split pattern of byte-level BPE, with Unicode white space spelled out.
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the runs (start, size), one after another."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


class _Index(dict):
    """Numbers keys as they come and lists the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str | tuple[str]] = []

    def __missing__(self, key: str | tuple[str]) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Units:
    """Encodes texts unit by unit, each different unit once while the cache keeps it.

    Every space and line end between two characters that are not white space begins a
    piece of the split pattern, so a text falls into units there, and the ids of a text
    are those of its units.  A text with two white space characters side by side, or
    with an added token in it, is cut into the pattern's own pieces instead.

    encode_units takes strings and returns (all ids, number of ids of each).
    """

    def __init__(self, encode_units: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], added: dict[str, int]) -> None:
        self.encode_units, self.added = encode_units, added
        self.pattern = regex.compile(SPLIT)
        # two side by side; \s takes in \x1c to \x1f, which the pattern does not, and nothing less
        self.odd = re.compile(r"\s\s")
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        self._reset()

    def _reset(self) -> None:
        self.index, self.flat = _Index(), np.zeros(0, np.int32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids as int32, number of ids of each text)."""
        if len(self.index) > CACHE_UNITS:
            self._reset()
        found: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        look, add = self.index.__getitem__, found.extend
        for n, text in enumerate(texts):
            was = len(found)
            if self.cut is not None and any(x in text for x in self.added):
                for k, piece in enumerate(self.cut.split(text)):
                    if k % 2:
                        found.append(-1 - self.added[piece])
                    else:
                        add(look((x,)) for x in self.pattern.findall(piece))
            elif self.odd.search(text):
                add(look((x,)) for x in self.pattern.findall(text))
            elif text:
                units = text.replace("\n", " \n").split(" ")
                if first := units[0]:
                    found.append(look((first,)))
                del units[0]
                add(map(look, units))
            counts[n] = len(found) - was
        if new := self.index.new:
            ids, sizes = self.encode_units([x[0] if isinstance(x, tuple) else x if x.startswith("\n") else " " + x for x in new])
            self.index.new = []
            self.flat = np.concatenate((self.flat, ids))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.starts = np.cumsum(self.sizes) - self.sizes
        at = np.array(found, np.int64)
        own = at < 0
        some = bool(own.any())
        sizes = self.sizes[np.maximum(at, 0)] if len(self.sizes) else np.zeros(len(at), np.int64)
        if some:
            sizes[own] = 1
        ends = np.concatenate(([0], np.cumsum(sizes)))
        if some:
            flat = np.zeros(int(ends[-1]), np.int32)
            flat[ends[:-1][own]] = (-1 - at[own]).astype(np.int32)
            flat[ragged(ends[:-1][~own], sizes[~own])] = self.flat[ragged(self.starts[at[~own]], sizes[~own])]
        else:
            flat = self.flat[ragged(self.starts[at], sizes)]
        cuts = np.concatenate(([0], np.cumsum(counts)))
        return flat, ends[cuts[1:]] - ends[cuts[:-1]]


class Bpe:
    """Vocabulary and merges of a byte-level BPE tokenizer file."""

    def __init__(self, spec: str) -> None:
        config = json.loads(spec)
        model = config["model"]
        vocab: dict[str, int] = model["vocab"]
        alphabet = byte_alphabet()
        self.symbol = np.array([vocab.get(c, -1) for c in alphabet], np.int64)
        if (self.symbol < 0).any():
            raise ValueError("the vocabulary lacks bytes: not a byte-level tokenizer")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort((left << 32) + right, kind="stable")
        self.pairs, self.rank, self.made = ((left << 32) + right)[order], order.astype(np.int64), made
        self.added = {t["content"]: t["id"] for t in config.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        to_byte = {c: b for b, c in enumerate(alphabet)}
        spelled = [b""] * size
        for word, i in vocab.items():
            spelled[i] = bytes(to_byte[c] for c in word)
        for word, i in self.added.items():
            spelled[i] = word.encode()
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.byte_sizes = np.array([len(x) for x in spelled], np.int64)
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.units = Units(self.encode_units, self.added)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [self.units.pattern.findall(x) for x in units]
        ids, sizes = self.words([w.encode("utf-8", "surrogatepass") for x in pieces for w in x])
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum([len(x) for x in pieces])))]
        return ids, np.diff(ends)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.units.encode(texts)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of symbols, or NONE."""
        key = (a << 32) + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.rank[at], NONE)

    def _merge(self, symbols: np.ndarray, sizes: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols and their number for words of one tree size.

        symbols: (words, leaves + 1), -1 beyond a word's end.
        """
        n, width = symbols.shape
        row = np.arange(n)
        # a place of -1 stands before the first symbol and keeps its value in the last, spare cell
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        places = np.arange(leaves)
        tree = np.full((n, 2 * leaves), NONE)
        rank = self.ranks(symbols[:, :-1], symbols[:, 1:])
        tree[:, leaves:] = np.where(rank < NONE, rank * leaves + places, NONE)
        for level in range(leaves.bit_length() - 2, -1, -1):
            at = 1 << level
            tree[:, at:2 * at] = np.minimum(tree[:, 2 * at:4 * at:2], tree[:, 2 * at + 1:4 * at:2])
        while len(row := row[tree[row, 1] < NONE]):
            best = tree[row, 1]
            i, k = best % leaves, best // leaves
            j = after[row, i]
            symbols[row, i] = self.made[k]
            symbols[row, j] = -1
            nxt = after[row, j]
            after[row, i] = nxt
            inside = nxt < width
            before[row[inside], nxt[inside]] = i[inside]
            prev = before[row, i]
            here = np.where(inside, self.ranks(symbols[row, i], symbols[row, np.minimum(nxt, width - 1)]), NONE)
            there = np.where(prev >= 0, self.ranks(symbols[row, prev], symbols[row, i]), NONE)
            changed = [(row, i, here), (row, j, np.full(len(row), NONE)), (row[prev >= 0], prev[prev >= 0], there[prev >= 0])]
            for r, leaf, value in changed:
                ok = leaf < leaves
                r, leaf, value = r[ok], leaf[ok], value[ok]
                tree[r, leaves + leaf] = np.where(value < NONE, value * leaves + leaf, NONE)
            for r, leaf, _ in changed:
                ok = leaf < leaves
                r, node = r[ok], (leaf[ok] + leaves) >> 1
                while len(node) and node[0] > 0:
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                    node = node >> 1
        live = (symbols >= 0) & (np.arange(width) < sizes[:, None])
        return symbols[live], live.sum(1)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each word)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out_sizes = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        # leaves: the least power of two that holds a word's pairs
        height = np.ceil(np.log2(np.maximum(sizes - 1, 1))).astype(np.int64)
        for h in np.unique(height[sizes > 0]):
            leaves = 1 << int(h)
            members = np.nonzero((height == h) & (sizes > 0))[0]
            for at in range(0, len(members), max(1, TREE_CELLS // (2 * leaves))):
                m = members[at:at + max(1, TREE_CELLS // (2 * leaves))]
                symbols = np.full((len(m), leaves + 1), -1, np.int64)
                inside = np.arange(leaves + 1) < sizes[m][:, None]
                symbols[inside] = self.symbol[data[ragged(starts[m], sizes[m])]]
                ids, n = self._merge(symbols, sizes[m], leaves)
                out_sizes[m] = n
                parts.append((m, ids))
        out_starts = np.cumsum(out_sizes) - out_sizes
        flat = np.zeros(int(out_sizes.sum()), np.int32)
        for m, ids in parts:
            flat[ragged(out_starts[m], out_sizes[m])] = ids
        return flat, out_sizes

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of runs of ids; bytes that are not UTF-8 become replacement characters."""
        sizes = self.byte_sizes[ids]
        data = self.bytes[ragged(self.byte_starts[ids], sizes)].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about CHUNK_CHARS characters."""
    start = total = 0
    for n, text in enumerate(texts):
        total += len(text or "")
        if total >= CHUNK_CHARS:
            yield start, n + 1
            start, total = n + 1, 0
    if start < len(texts):
        yield start, len(texts)


def tokenizer_spec(path: str) -> str:
    """The tokenizer file's text, read where the job is declared; its size is fixed."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, decoded) for every row: ids as little-endian unsigned 32-bit
    integers, and the text decoded from them.

    Null text is empty text, which has no ids.  Added tokens that a text spells out
    are taken as such.  Repeated rows and null ids give a row each; further columns
    are not read; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_spec(path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_in_worker(f"bpe {hash(shared.value)}", lambda: Bpe(shared.value))
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                ids, counts = codec.encode(texts[a:b])
                decoded = codec.decode(ids, counts)
                raw = ids.astype("<u4").tobytes()
                cuts = np.concatenate(([0], 4 * np.cumsum(counts))).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([raw[x:y] for x, y in zip(cuts, cuts[1:])], pa.binary()),
                                                  pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, ids binary, decoded string").withColumnRenamed("id", id_col)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe(docs, default_tokenizer()).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
