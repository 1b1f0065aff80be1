"""Prefix trie of conversations by a splitter skeleton (operator 13).

Conversations become paths of turn digests and are sorted by path into shards.  The
shards' borders are the paths of drawn conversations (splitters), and only nodes on a
splitter's path can lie in two shards: their trie is the skeleton, which is
broadcast.  Every other node lies in one sorted shard, whose task finishes it with a
stack while it reads.  For skeleton nodes shards emit partial aggregates, which are
reduced and then added up along the skeleton.  The draw decides how even the shards
are, never a result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefp.session import materialize

WIDTH = 16
HEAD_TURNS = 8
SHARD_CONVERSATIONS = 20_000
MOST_SHARDS = 16_384
DRAWN_PER_SHARD = 16
SPLITTER_TURNS = 4_096
PIECE_TURNS = 4_096
ENDS_CHARS = 1_000_000
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, head, digest, bytes, uid); a digest is md5 over role and text."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.md5(r), t)))
    return conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), r.alias("role"), F.left(t, F.lit(32)).alias("head"),
        digest.alias("digest"), F.octet_length(t).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("uid"))


def paths(rows: DataFrame) -> DataFrame:
    """(conv, path, sizes): digests and text bytes of each conversation in turn order.

    Turns of a conversation meet in pieces, cut where a sorted partition ends or after
    PIECE_TURNS turns, so that a long one is not ordered in one task.
    """
    keys = ["conv", "turn", "role", "head", "digest", "uid"]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "digest", "bytes")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 32
        conv: int | None = None
        digests: list[bytes] = []
        sizes: list[int] = []
        names = ["conv", "seq", "path", "sizes"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        for b in batches:
            out: list[tuple] = []
            for c, d, n in zip(*(x.to_pylist() for x in b.columns)):
                if digests and (c != conv or len(digests) >= PIECE_TURNS):
                    out.append((conv, seq, b"".join(digests), sizes))
                    seq, digests, sizes = seq + 1, [], []
                conv = c
                digests.append(d)
                sizes.append(n)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
        if digests:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((conv, seq, b"".join(digests), sizes), kinds)], names)

    made = sorted_rows.mapInArrow(pieces, "conv long, seq long, path binary, sizes array<long>")
    parts = F.array_sort(F.collect_list(F.struct("seq", "path", "sizes")))
    # binary pieces are joined as hexadecimal text: array_join takes no binary
    return made.groupBy("conv").agg(parts.alias("p")).select(
        "conv", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["path"])), "")).alias("path"),
        F.flatten(F.transform("p", lambda x: x["sizes"])).alias("sizes"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Conversation c begins with the first h turns of c - c % 5 (remainder of the sign
    of c) and goes on with its own behind its first h; h = crc32(decimal c) % 9."""
    def upto(h: Column | int) -> tuple[Column, Column]:
        return F.substring("path", F.lit(1), WIDTH * F.lit(h)), F.slice("sizes", F.lit(1), F.lit(h))

    heads = own.where("conv % 5 = 0").select(F.col("conv").alias("base"), *(c.alias(n) for c, n in zip(upto(HEAD_TURNS), ("base_path", "base_sizes"))))
    h = (F.crc32(F.col("conv").cast("string")) % 9).cast("int")
    nothing = F.lit(b""), F.array().cast("array<long>")
    both = own.withColumn("base", F.col("conv") - F.col("conv") % 5).join(heads, "base", "left").withColumn("h", h)
    return both.select(
        "conv", F.concat(F.coalesce(F.substring("base_path", F.lit(1), WIDTH * F.col("h")), nothing[0]),
                         F.substring("path", WIDTH * F.col("h") + 1, F.greatest(F.length("path") - WIDTH * F.col("h"), F.lit(0)))).alias("path"),
        F.concat(F.coalesce(F.slice("base_sizes", F.lit(1), F.col("h")), nothing[1]),
                 F.slice("sizes", F.col("h") + 1, F.greatest(F.size("sizes") - F.col("h"), F.lit(0)))).alias("sizes"))


@dataclass
class Skeleton:
    """Borders between shards and the trie of their paths, node 0 its root."""

    borders: list[tuple[bytes, int]]
    child: dict[tuple[int, bytes], int] = field(default_factory=dict)
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])

    @staticmethod
    def of(borders: list[tuple[bytes, int]]) -> Skeleton:
        s = Skeleton(borders)
        for path, _ in borders:
            node = 0
            for at in range(0, len(path), WIDTH):
                key = node, path[at:at + WIDTH]
                if key not in s.child:
                    s.child[key] = len(s.parent)
                    s.parent.append(node)
                    s.depth.append(s.depth[node] + 1)
                node = s.child[key]
        return s


def skeleton(all_paths: DataFrame) -> Skeleton:
    """Borders by rank among drawn conversations; the draw is at most DRAWN_PER_SHARD a
    shard, about, and a border keeps at most SPLITTER_TURNS turns of its path."""
    spark = all_paths.sparkSession
    total = all_paths.count()
    shards = min(MOST_SHARDS, max(ceil(total / SHARD_CONVERSATIONS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    share = min(1.0, shards * DRAWN_PER_SHARD / max(total, 1))
    path = F.substring("path", F.lit(1), F.lit(WIDTH * SPLITTER_TURNS))
    drawn = sorted((bytes(r[0]), r[1]) for r in all_paths.where(F.pmod(F.xxhash64("conv"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
                   .select(path, "conv").collect())
    return Skeleton.of(sorted({drawn[len(drawn) * k // shards] for k in range(1, shards)}) if drawn else [])


@dataclass
class Open:
    """A node on the stack of a shard."""

    shared: int
    depth: int
    size: int
    least: int | None = None
    members: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: list[str] = field(default_factory=list)
    ends_chars: int = 0
    hash: object = None
    pieces: int = 0
    waiting: list[tuple] = field(default_factory=list)


SHARD = ("kind string, node long, shard long, piece long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, size long, ends string")
SHARD_NAMES = [x.split()[0] for x in SHARD.split(", ")]
SHARD_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in SHARD.split(", ")]


class Walk:
    """The nodes of one shard, finished as its paths pass in order."""

    def __init__(self, shard: int, bone: Skeleton) -> None:
        self.shard, self.bone, self.path = shard, bone, b""
        self.stack = [Open(0, 0, 0)]
        self.out: list[tuple] = []

    def put(self, kind: str, node: int | None = None, piece: int | None = None, conv: int | None = None, depth: int | None = None, parent: int | None = None,
            members: int | None = None, children: int | None = None, leaves: int | None = None, saved: int | None = None, size: int | None = None,
            ends: str | None = None) -> tuple:
        return kind, node, self.shard, piece, conv, depth, parent, members, children, leaves, saved, size, ends

    def add(self, path: bytes, conv: int, sizes: list[int]) -> None:
        same, top = 0, min(len(path), len(self.path))
        while same < top and path[same:same + WIDTH] == self.path[same:same + WIDTH]:
            same += WIDTH
        while len(self.stack) > same // WIDTH + 1:
            self.close()
        for at in range(same, len(path), WIDTH):
            up = self.stack[-1]
            shared = self.bone.child.get((up.shared, path[at:at + WIDTH]), -1) if up.shared >= 0 else -1
            self.stack.append(Open(shared, up.depth + 1, sizes[at // WIDTH]))
        self.path = path
        # members are counted where they end and handed up as nodes close
        end = self.stack[-1]
        end.members += 1
        end.least = conv if end.least is None else min(end.least, conv)
        text = str(conv) if end.pieces == 0 and not end.ends and end.hash is None else f",{conv}"
        end.ends.append(text)
        end.ends_chars += len(text)
        if end.ends_chars >= ENDS_CHARS:
            self.spill(end)

    def spill(self, node: Open) -> None:
        """Bounded memory for a node at which very many conversations end."""
        text = "".join(node.ends)
        if node.shared >= 0:
            self.out.append(self.put("ends", node.shared, node.pieces, ends=text))
            node.pieces += 1
        else:
            node.hash = node.hash or hashlib.sha256()
            node.hash.update(text.encode())
        node.ends, node.ends_chars = [], 0

    def close(self) -> None:
        node = self.stack.pop()
        up = self.stack[-1] if self.stack else None
        if node.ends:
            self.spill(node)
        if up is not None:
            up.members += node.members
            up.least = node.least if up.least is None else min(up.least, node.least)
        if node.shared < 0:
            node.saved += (node.members - 1) * node.size
            node.leaves += not node.children
            up.children += 1
            sha = (node.hash or hashlib.sha256()).hexdigest()
            up.waiting.append((node.least, node.depth, node.members, node.children, node.leaves, node.saved, sha))
        else:
            self.out.append(self.put("part", node.shared, conv=node.least, depth=node.depth, members=node.members, children=node.children,
                                     leaves=node.leaves, saved=node.saved, size=node.size))
        if up is not None:
            up.leaves += node.leaves
            up.saved += node.saved
        for least, depth, members, children, leaves, saved, sha in node.waiting:
            at = None if node.shared < 0 else node.shared
            self.out.append(self.put("node", at, conv=least, depth=depth, parent=None if at is not None else node.least, members=members, children=children,
                                     leaves=leaves, saved=saved, ends=sha))
        node.waiting = []

    def flush(self, most: int = 5_000) -> None:
        """Children of skeleton nodes wait for no parent."""
        for node in self.stack:
            if node.shared >= 0 and len(node.waiting) >= most:
                self.out += [self.put("node", node.shared, conv=x[0], depth=x[1], members=x[2], children=x[3], leaves=x[4], saved=x[5], ends=x[6])
                             for x in node.waiting]
                node.waiting = []

    def end(self) -> None:
        while self.stack:
            self.close()


def prefix_trie(all_paths: DataFrame) -> DataFrame:
    """One row per node of (conv, path, sizes), conv unlike for every row.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.  A path is one row of 24 bytes a
    turn.  Turns are equal if the md5 of role and text is.  No rows give no nodes.
    """
    spark = all_paths.sparkSession
    bone = skeleton(all_paths)
    shared = spark.sparkContext.broadcast(bone)
    shards = len(bone.borders) + 1

    def shard_of(keys: pd.DataFrame) -> pd.Series:
        borders = shared.value.borders
        return pd.Series([bisect_right(borders, (bytes(p), c)) for p, c in zip(keys["path"], keys["conv"])], dtype="int32")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Walk | None = None

        def sent() -> pa.RecordBatch:
            rows, now.out = now.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SHARD_TYPES)], SHARD_NAMES)

        for b in batches:
            for shard, path, conv, sizes in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or shard != now.shard:
                    if now is not None:
                        now.end()
                        yield sent()
                    now = Walk(shard, shared.value)
                now.add(path, conv, sizes)
                if len(now.out) >= 10_000:
                    yield sent()
            if now is not None:
                now.flush()
        if now is not None:
            now.end()
            yield sent()

    shard = F.pandas_udf(shard_of, "int")(F.struct("path", "conv"))
    dealt = all_paths.select(shard.alias("shard"), "path", "conv", "sizes").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv")
    rows = materialize(dealt.mapInArrow(walk, SHARD), "trie")

    parts = rows.where("kind = 'part'").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("size").alias("size"))

    def added(group: pd.DataFrame) -> pd.DataFrame:
        """Sums along the skeleton, whose size its borders bound; children have higher numbers."""
        bone = shared.value
        at = group.set_index("node")
        children = dict(zip(at.index, at["n_children"]))
        for n in at.index:
            if n:
                children[bone.parent[n]] += 1
        leaves, saved, least, members = (dict(zip(at.index, at[c])) for c in ("n_leaves", "saved_tokens", "conv_id", "n_convs"))
        more = {n: [0, 0] for n in at.index}
        for n in sorted(at.index, reverse=True):
            more[n][0] += int(not children[n])
            more[n][1] += (int(members[n]) - 1) * int(at["size"][n])
            if n:
                for k in (0, 1):
                    more[bone.parent[n]][k] += more[n][k]
        order = sorted(at.index)
        return pd.DataFrame({
            "node": order, "conv_id": [least[n] for n in order], "depth": [bone.depth[n] for n in order],
            "parent_conv_id": pd.array([least[bone.parent[n]] if n else None for n in order], dtype="Int64"), "n_convs": [members[n] for n in order],
            "n_children": [children[n] for n in order], "n_leaves": [leaves[n] + more[n][0] for n in order],
            "saved_tokens": [saved[n] + more[n][1] for n in order]})

    whole = parts.groupBy(F.lit(0).alias("all")).applyInPandas(
        added, "node long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    whole = materialize(whole, "skeleton")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node: int | None = None
        digest = hashlib.sha256()
        for b in batches:
            for n, text in zip(*(c.to_pylist() for c in b.columns)):
                if n != node:
                    if node is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])
                    node, digest = n, hashlib.sha256()
                    digest.update(text.encode())
                else:
                    digest.update((text if text.startswith(",") else f",{text}").encode())
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    ends = (rows.where("kind = 'ends'").select("node", "shard", "piece", "ends").repartition("node").sortWithinPartitions("node", "shard", "piece")
            .select("node", "ends").mapInArrow(hashed, "node long, ends_sha256 string"))
    empty = hashlib.sha256(b"").hexdigest()
    top = whole.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
    # a node below the skeleton learns its parent's smallest member here
    parents = whole.select("node", F.col("conv_id").alias("up"))
    # 16 bytes a skeleton node, whose number is known
    parents = F.broadcast(parents) if len(bone.parent) <= 200_000 else parents
    below = (rows.where("kind = 'node'").join(parents, "node", "left")
             .select(*(F.coalesce("parent_conv_id", "up").alias(c) if c == "parent_conv_id" else F.col("ends").alias(c) if c == "ends_sha256" else F.col(c) for c in NODE)))
    return top.select(*NODE).unionByName(below)


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of rebuilt conversations.

    Turns go by turn (null first), rows of one turn by role and text; null role or text
    is empty; rows without an id belong to no conversation; further columns are not
    read; an empty table gives no nodes.
    """
    rows = turn_rows(conversations, id_col, turn_col, role_col, text_col)
    own = materialize(paths(rows), "paths")
    return prefix_trie(materialize(rebuilt(own), "rebuilt"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
