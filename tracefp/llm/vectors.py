"""Embedding near-duplicates by spherical k-means and blocked cosines (operator 6).

Vectors are scaled to length one in double precision.  Spherical k-means, fitted on a
bounded sample, gives cells, and every vector has its nearest one as home.  Two
vectors of cosine s are at most sqrt(2 - 2 s) apart, so for a pair with homes c and
d the distances to the plane that parts the two cells add up to no more, and one of
them is at most half of it: that vector visits the other's cell.  Members meet
members and visitors there, so every pair at or above the threshold is found; a
pair that meets twice counts in the lower cell.

Cells are cut into blocks of about BLOCK vectors by a hash, and a task takes one pair
of blocks: a product of two bounded matrices.  It emits the number of links of each
vector and a spanning forest of them, never the links.  Equal vectors are one,
with a weight.

A vector is copied once for every pair of blocks it takes part in, which is many times
the input.  Pairs are therefore dealt over rounds, each of about as many copies as there
are vectors; a round's shuffle files are given up before the next begins, so disk holds
one written table of vectors and one round, however many pairs there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefp.llm.components import components
from tracefp.llm.store import settled
from tracefp.session import materialize

SIMILARITY = 0.95
SAMPLE = 20_000
CELL, MOST_CELLS = 1_000, 2_048
BLOCK = 1_024
GUEST_BLOCKS = 4
LEAST_ROUND = 500_000
ROUNDS = 8
SLACK = 1e-9


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centroids; empty cells take the sample's worst placed vectors."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = np.empty(len(x), np.int64)
        best = np.empty(len(x))
        for a in range(0, len(x), 4096):
            s = x[a:a + 4096] @ c.T
            home[a:a + 4096], best[a:a + 4096] = s.argmax(1), s.max(1)
        new = np.zeros_like(c)
        np.add.at(new, home, x)
        norm = np.linalg.norm(new, axis=1)
        void = norm < 1e-9
        new[void] = x[np.argsort(best)[:void.sum()]]
        norm[void] = 1
        c = new / norm[:, None]
    return c


def linkable(column: pa.Array) -> list[int]:
    """Rows of the vectors that can link: finite, without nulls, not zero."""
    at = []
    for n, v in enumerate(column.to_pylist()):
        if v and not any(x is None for x in v):
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                at.append(n)
    return at


def unit_rows(raw: list[bytes], kind: str, dim: int) -> np.ndarray:
    """Vectors as they came, scaled to length one in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _raw(column: pa.Array, at: list[int], kind: str) -> list[bytes]:
    return [np.array(v, kind).tobytes() for v in column.take(pa.array(at, pa.int64())).to_pylist()]


def _placed(vectors: DataFrame, centroids: dict[int, np.ndarray], reach: float, kind: str) -> DataFrame:
    """(rep, n, dim, raw, home, visits): vectors that can link, those of one length one dim,
    with the cell that is nearest and the cells they visit."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = linkable(batch.column("v"))
            raw = _raw(batch.column("v"), at, kind)
            dims = np.array([len(r) // np.dtype(kind).itemsize for r in raw], np.int32)
            home, visits = np.zeros(len(dims), np.int32), [[] for _ in raw]
            for dim in np.unique(dims):
                c = shared.value.get(int(dim))
                if c is None:
                    continue
                apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-18))
                rows = np.nonzero(dims == dim)[0]
                for a in range(0, len(rows), 2048):
                    part = rows[a:a + 2048]
                    s = unit_rows([raw[k] for k in part], kind, dim) @ c.T
                    own = s.argmax(1)
                    home[part] = own
                    near = (s[np.arange(len(part)), own][:, None] - s) / apart[own] <= reach
                    near[np.arange(len(part)), own] = False
                    for k, cells in zip(part, near):
                        visits[k] = np.nonzero(cells)[0].tolist()
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(take), batch.column("n").take(take), pa.array(dims), pa.array(raw, pa.binary()), pa.array(home),
                                              pa.array(visits, pa.list_(pa.int32()))], ["rep", "n", "dim", "raw", "home", "visits"])

    return vectors.select("rep", "n", "v").mapInArrow(run, f"rep {dict(vectors.dtypes)['rep']}, n long, dim int, raw binary, home int, visits array<int>")


def _forest(a: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest label reachable in the bipartite links a (left x right)."""
    left, right = left.copy(), right.copy()
    while True:
        low = np.minimum(left, np.where(a, right[None, :], np.iinfo(np.int64).max).min(1))
        far = np.minimum(right, np.where(a, low[:, None], np.iinfo(np.int64).max).min(0))
        if (low == left).all() and (far == right).all():
            return left, right
        left, right = low, far


def _meet(similarity: float, kind: str):
    def run(table: pa.Table) -> pa.Table:
        reps = table.column("rep").to_pylist()
        dim = table.column("dim")[0].as_py()
        x = unit_rows(table.column("raw").to_pylist(), kind, dim)
        n, side = table.column("n").to_numpy(), table.column("side").to_numpy()
        left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        own = not len(right) and table.column("i")[0].as_py() == table.column("j")[0].as_py() and not table.column("guests")[0].as_py()
        if own:
            right = left
        empty = pa.table({"rep": pa.array([], table.schema.field("rep").type), "links": pa.array([], pa.int64()), "root": pa.array([], table.schema.field("rep").type)})
        if not len(left) or not len(right):
            return empty
        a = x[left] @ x[right].T >= similarity
        if own:
            np.fill_diagonal(a, False)
        elif table.column("guests")[0].as_py():
            # a visitor whose home the member visits meets it there too: the lower cell counts
            cell = table.column("cell")[0].as_py()
            homes = table.column("home").to_numpy()[right]
            visits = table.column("visits").to_pylist()
            lower = set(homes[homes < cell].tolist())
            for k, m in enumerate(left):
                both = lower.intersection(visits[m])
                if both:
                    a[k] &= ~np.isin(homes, list(both))
        la, ra = a.any(1), a.any(0)
        if not la.any():
            return empty
        a, left, right = a[la][:, ra], left[la], right[ra]
        order = sorted(set(left.tolist()) | set(right.tolist()), key=lambda k: tuple(reps[k].values()))
        rank = np.zeros(len(reps), np.int64)
        rank[order] = np.arange(len(order))
        roots = _forest(a, rank[left], rank[right])
        counts = np.zeros(len(reps), np.int64)
        counts[left] += a @ n[right]
        if not own:
            counts[right] += a.T @ n[left]
        root = np.zeros(len(reps), np.int64)
        root[left] = roots[0]
        root[right] = roots[1] if not own else root[right]
        return pa.table({"rep": table.column("rep").combine_chunks().take(pa.array(order)), "links": pa.array(counts[order]),
                         "root": table.column("rep").combine_chunks().take(pa.array([order[root[k]] for k in order]))})

    return run


def _pairs(members: DataFrame, guests: DataFrame, blocks: DataFrame, h: Column, turn: int, rounds: int) -> DataFrame:
    """The copies of one round: blocks i and j of a cell meet in round (i + j + cell) mod rounds."""
    def others(many: str) -> Column:
        begin = F.pmod(F.lit(turn) - F.col("b") - F.col("cell"), F.lit(rounds))
        return F.when(begin < F.col(many), F.sequence(begin, F.col(many) - 1, F.lit(rounds).cast("long")))

    def cut(rows: DataFrame, own: str) -> DataFrame:
        return rows.join(F.broadcast(blocks), ["dim", "cell"]).where(F.col(own) > 0).withColumn("b", h % F.col(own))

    def copies(rows: DataFrame, many: str, guest: bool, i: Column, j: Column, side: Column, seen: bool = False) -> DataFrame:
        visits = "visits" if seen else F.lit(None).cast("array<int>").alias("visits")
        return rows.select("*", F.explode(others(many)).alias("o")).select(
            "dim", "cell", F.lit(guest).alias("guests"), i.alias("i"), j.alias("j"), side.alias("side"), "rep", "n", "raw", "home", visits)

    member, b, o = cut(members, "mb"), F.col("b"), F.col("o")
    among = copies(member, "mb", False, F.least(b, o), F.greatest(b, o), F.when(b <= o, 0).otherwise(1))
    hosts = copies(member, "gb", True, b, o, F.lit(0), seen=True)
    return among.unionByName(hosts).unionByName(copies(cut(guests, "gb"), "mb", True, o, b, F.lit(1)))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = SIMILARITY, cell: int = CELL,
                 block: int = BLOCK, least_round: int = LEAST_ROUND) -> DataFrame:
    """One row per row of vectors: id_col, n_links (other rows at the similarity or
    above), component_id (smallest id reachable, its own included), kept.

    Vectors that are null, empty, zero or hold a null or a non-finite number link with
    nothing; vectors of different lengths do not link with each other.  Rows that repeat
    an id are rows of their own; a row without an id links with nothing and is not kept.
    Further columns are not read; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).withColumns(
        {"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})
    element = dict(vectors.dtypes)[vector_col]
    kind = "<f4" if element == "array<float>" else "<f8"
    known = rows.where("id IS NOT NULL AND v IS NOT NULL")
    # equal vectors are one node, named by their smallest id and their hash
    kinds = known.groupBy("k1", "k2").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).select(
        "k1", "k2", F.struct(F.col("low").alias("id"), "k1", "k2").alias("rep"), "n", "dim")
    kinds = materialize(kinds, "kinds")
    centroids = {}
    for dim, count in [(r["dim"], r["count"]) for r in kinds.groupBy("dim").count().collect()]:
        k = min(MOST_CELLS, max(1, count // cell))
        if k > 1:
            some = kinds.where(F.col("dim") == dim).orderBy(F.xxhash64("rep")).limit(SAMPLE).select("k1", "k2", F.col("rep.id").alias("id"))
            sample = known.join(F.broadcast(some), ["k1", "k2", "id"]).dropDuplicates(["k1", "k2"]).select("v").toArrow().column("v").combine_chunks()
            at = linkable(sample)
            if len(at) > 1:
                centroids[dim] = kmeans(unit_rows(_raw(sample, at, kind), kind, dim), min(k, len(at)))
    first = known.groupBy("k1", "k2").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.min_by("v", "id").alias("v")).select(
        F.struct(F.col("low").alias("id"), "k1", "k2").alias("rep"), "n", "v")
    placed = settled(_placed(first, centroids, np.sqrt(max(0.0, 2 - 2 * similarity)) / 2 + SLACK, kind), "placed")
    members = placed.select("*", F.col("home").alias("cell"), F.lit(0).alias("guest"))
    guests = placed.select("*", F.explode("visits").alias("cell"), F.lit(1).alias("guest"))
    # one row per cell, whose number is bounded by MOST_CELLS for each length
    counts = members.groupBy("dim", "cell").agg(F.count("*").alias("m")).join(
        guests.groupBy("dim", "cell").agg(F.count("*").alias("g")), ["dim", "cell"], "left").withColumn("g", F.coalesce("g", F.lit(0)))
    blocks = materialize(counts.select("dim", "cell", F.ceil(F.col("m") / block).alias("mb"), F.ceil(F.col("g") / (GUEST_BLOCKS * block)).alias("gb"), "m", "g"), "blocks")
    size = blocks.agg(F.sum("m"), F.sum(F.col("m") * (F.col("mb") + F.col("gb")) + F.col("g") * F.col("mb"))).first()
    rounds = -(-(size[1] or 0) // max(size[0] or 0, least_round)) or 1
    h = F.pmod(F.xxhash64("rep", "cell"), F.lit(1 << 30))
    node = dict(kinds.dtypes)["rep"]
    met = None
    for turn in range(rounds):
        out = settled(_pairs(members, guests, blocks.drop("m", "g"), h, turn, rounds).groupBy("dim", "cell", "guests", "i", "j").applyInArrow(
            _meet(similarity, kind), f"rep {node}, links long, root {node}"), "met")
        met = out if met is None else met.unionByName(out)
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    # rows that link with nothing at all have no unit vector, and their copies do not link either
    linked = placed.select("rep", "n").join(links, "rep", "left").join(groups, "rep", "left").select(
        "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep")["id"].alias("component_id"))
    by_kind = kinds.select("k1", "k2", "rep").join(linked, "rep")
    out = rows.select("id", "k1", "k2").join(by_kind.select("k1", "k2", "n_links", "component_id"), ["k1", "k2"], "left")
    has = F.col("id").isNotNull() & F.col("n_links").isNotNull()
    out = out.select("id", F.when(has, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
                     F.when(has, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
