"""Every link between the sets of a crowd that are not yet in one component.

Bands of hashes do not part a crowd, so it is joined by prefixes.  Tokens are ordered by
how many sets have them, the rarest first; two sets of Jaccard similarity t or more
have a token in common among the first n - ceil(t n) + 1 of each, and at the first such
token enough tokens are left behind it in both.  Both bounds are exact.  Rare tokens
part lines around a common template; near copies are mostly in one component by the
links known before, and pairs inside a component are not made.  What is made
is verified by the exact similarity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefp.llm.components import components
from tracefp.llm.store import settled


def crowd_links(sets: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of (node, set of distinct longs); with ``links`` (a, b) their components
    are those of all pairs of nodes at the similarity or more."""
    t = F.lit(similarity)
    known = components(links)
    sets = settled(sets.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "set"), "crowd")
    tokens = sets.select("node", "component", F.size("set").alias("n"), F.explode("set").alias("token"))
    # a token of one component makes no pair, but has its place in the order
    counts = settled(tokens.groupBy("token").agg(F.count("*").alias("count"), (F.min("component") != F.max("component")).alias("mixed")), "tokens")
    ordered = tokens.join(counts, "token").groupBy("node", "component", "n").agg(F.array_sort(F.collect_list(F.struct("count", "token", "mixed"))).alias("by"))
    # less a little, so that rounding makes no prefix too short
    first = F.slice("by", 1, F.col("n") - F.ceil(t * F.col("n") - F.lit(1e-9)).cast("int") + 1)
    prefix = settled(ordered.select("node", "component", "n", F.posexplode(first).alias("place", "by")).where("by.mixed").select(
        F.col("by.token").alias("token"), "node", "component", "n", (F.col("n") - F.col("place")).alias("left")), "prefixes")
    a, b = (prefix.withColumnsRenamed({c: f"{c}_{s}" for c in ("node", "component", "n", "left")}) for s in "ab")
    size = F.least("n_a", "n_b") >= t * F.greatest("n_a", "n_b") - F.lit(1e-9)
    room = (t + 1) * F.least("left_a", "left_b") >= t * (F.col("n_a") + F.col("n_b")) - F.lit(1e-9)
    pairs = settled(a.join(b, "token").where(F.col("component_a") < F.col("component_b")).where(size & room).select("node_a", "node_b").distinct(), "pairs")
    own = sets.select("node", "set")
    both = pairs.join(own.withColumnsRenamed({"node": "node_a", "set": "set_a"}), "node_a").join(own.withColumnsRenamed({"node": "node_b", "set": "set_b"}), "node_b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(common >= t * (F.size("set_a") + F.size("set_b") - common)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
