"""Exact quantiles and modes that survive a key holding a third of all rows.

Both collapse equal values first (map-side combined counts), so copies cost
nothing, and neither keeps the values of a key in one aggregation buffer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Values of one power of two are cut into this many bins.
_BINS = 128


def _bin(value: Column) -> Column:
    """A whole number that never decreases as the value grows."""
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    rank = ((exponent + 1100) * _BINS
            + F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * _BINS))
    return (F.when(value == 0, F.lit(0)).when(value > 0, rank).otherwise(-rank)).cast("long")


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                      wanted: Mapping[str, float], weight: str | None = None) -> DataFrame:
    """One row per key with linearly interpolated quantiles of `value`; `weight` names a
    column holding how many rows a row stands for.

    Counts per bin locate the bins that hold the wanted ranks; only rows of
    those bins are ranked.  Nulls are ignored; keys without values are absent.
    """
    whole = not keys
    keys = list(keys) or ["_all"]
    src = df.withColumn("_all", F.lit(1)) if whole else df
    counts = (src.where(F.col(value).isNotNull())
              .groupBy(*keys, F.col(value).cast("double").alias("_v"))
              .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
              .withColumn("_b", _bin(F.col("_v"))))
    by_key = Window.partitionBy(*keys)
    bins = (counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
            .select(*keys, "_b", "_bn",
                    F.sum("_bn").over(by_key.orderBy("_b")
                                      .rowsBetween(Window.unboundedPreceding, 0)).alias("_cum"),
                    F.sum("_bn").over(by_key).alias("_tot")))
    ranks = []
    for name, q in wanted.items():
        pos = F.lit(float(q)) * (F.col("_tot") - 1)
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            ranks.append(F.struct(F.lit(f"{name}|{side}").alias("name"),
                                  rank.cast("long").alias("rank"),
                                  (pos - F.floor(pos)).alias("frac")))
    hit = F.filter(F.array(*ranks), lambda r: (r["rank"] < F.col("_cum"))
                   & (r["rank"] >= F.col("_cum") - F.col("_bn")))
    targets = (bins.withColumn("_hit", hit).where(F.size("_hit") > 0)
               .select(*keys, "_b", (F.col("_cum") - F.col("_bn")).alias("_start"), "_hit"))
    in_bin = (Window.partitionBy(*keys, "_b").orderBy("_v")
              .rowsBetween(Window.unboundedPreceding, 0))
    picked = (counts.join(targets, [*keys, "_b"])
              .withColumn("_end", F.col("_start") + F.sum("_n").over(in_bin))
              .withColumn("_h", F.explode("_hit"))
              .where((F.col("_h.rank") < F.col("_end"))
                     & (F.col("_h.rank") >= F.col("_end") - F.col("_n"))))
    side = {s: [F.max(F.when(F.col("_h.name") == f"{n}|{s}", F.col("_v"))).alias(f"_{s}_{n}")
                for n in wanted] for s in ("lo", "hi")}
    frac = [F.max(F.when(F.col("_h.name") == f"{n}|lo", F.col("_h.frac"))).alias(f"_f_{n}")
            for n in wanted]
    out = picked.groupBy(*keys).agg(*side["lo"], *side["hi"], *frac)
    cols = [(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in wanted]
    return out.select(*([] if whole else keys), *cols)


def value_counts(df: DataFrame, keys: Sequence[str], fields: Sequence[str],
                 value: str = "value", weight: str | None = None) -> DataFrame:
    """(keys, field, value, number, n) for every non-null value of each field.

    `number` is the value as a double for numeric fields, else null; it decides
    ties the way the field's own type would.  `weight` names a column holding
    how many rows a row stands for.
    """
    types = dict(df.dtypes)
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    items = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(value),
                      (F.col(f) if types[f] in numeric or types[f].startswith("decimal")
                       else F.lit(None)).cast("double").alias("number"))
             for f in fields]
    extra = [F.col(weight).alias("_weight")] if weight else []
    n = F.sum("_weight") if weight else F.count(F.lit(1))
    return (df.select(*keys, *extra, F.inline(F.array(*items)))
            .where(F.col(value).isNotNull())
            .groupBy(*keys, "field", value, "number").agg(n.alias("n")))


def modal_rows(counts: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Most frequent value per (keys, field); ties go to the smallest value."""
    best = F.min(F.struct((-F.col("n")).alias("neg"), "number", value))
    return (counts.groupBy(*keys, "field")
            .agg(best.alias("_best"), F.count(F.lit(1)).alias("n_distinct"),
                 F.sum("n").alias("total"))
            .select(*keys, "field", F.col(f"_best.{value}").alias("modal"),
                    (-F.col("_best.neg")).alias("modal_n"), "n_distinct", "total"))


def grouped_modes(df: DataFrame, keys: Sequence[str], fields: Mapping[str, str],
                  weight: str | None = None) -> DataFrame:
    """One row per key with the mode of each column: {source column: output name}."""
    types = dict(df.dtypes)
    rows = modal_rows(value_counts(df, keys, list(fields), weight=weight), keys)
    return rows.groupBy(*keys).agg(*[
        F.max(F.when(F.col("field") == f, F.col("modal"))).cast(types[f]).alias(out)
        for f, out in fields.items()])
