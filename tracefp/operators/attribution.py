"""Assignment of requests and flushes to trial windows, and its summaries.

Open-source Spark plans a bare range condition as a nested loop, so windows
are copied into the time buckets they cover and met on the bucket; the exact
bounds are tested afterwards.  A bucket is as long as the windows in it: a
window's level is the power of two at or below its length, and it covers at
most three buckets of its level.  A record asks once per level in use, at most
64, in one bucket each, so no pair is formed twice, and the windows it meets
all lie within two of their own lengths.  No side is forced to broadcast: Spark does
so when the measured size allows, and otherwise splits a hot bucket as a skewed
join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bucket(us: Column, size: Column) -> Column:
    return F.floor(us / size).cast("long")


def _spread(windows: DataFrame, pad_us: int = 0) -> DataFrame:
    """Windows with padded bounds, one row per bucket of their level they touch."""
    w = (windows.withColumn("_s", F.col("s_us") - pad_us).withColumn("_e", F.col("e_us") + pad_us)
         .where(F.col("_e") >= F.col("_s")))
    w = w.withColumn("_size", F.expr("shiftleft(1L, CAST(floor(log2(greatest(_e - _s, 1))) AS INT))"))
    return w.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col("_s"), F.col("_size")), _bucket(F.col("_e"), F.col("_size")))))


def _levels(spread: DataFrame) -> Column:
    """Bucket lengths in use: powers of two, so at most 64 reach the driver."""
    sizes = sorted(r[0] for r in spread.select("_size").distinct().collect())
    return F.array(*[F.lit(s).cast("long") for s in sizes]).cast("array<bigint>")


def attribute_requests(requests: DataFrame, windows: DataFrame, closed: bool = True, pad_seconds: float = 0) -> DataFrame:
    """Requests inside [s, e] (closed) or [s, e), with the window's agent and trial."""
    w = _spread(windows, int(pad_seconds * 1_000_000))
    rows = (requests.drop("agent", "trial").withColumn("_size", F.explode(_levels(w)))
            .withColumn("_bucket", _bucket(F.col("us"), F.col("_size"))))
    inside = (F.col("us") >= F.col("_s")) & ((F.col("us") <= F.col("_e")) if closed else (F.col("us") < F.col("_e")))
    return (rows.join(w, ["_size", "_bucket"]).where(inside)
            .drop("_size", "_bucket", "_s", "_e", "s_us", "e_us"))


def attribute_by_marker(requests: DataFrame, windows: DataFrame, marker: str, pad_seconds: float = 5.0) -> DataFrame:
    """Requests of one source, told by a user-agent part, inside padded windows."""
    own = requests.where(F.coalesce("ua", F.lit("")).contains(marker))
    return attribute_requests(own, windows, True, pad_seconds)


def attribute_flushes(flushes: DataFrame, windows: DataFrame, times: str = "times", closed: bool = True) -> DataFrame:
    """A flush once per window that holds any of its event times.

    `times` is the array of event times of the flush.  A flush meets a window
    only in the bucket of its first event inside it, so no duplicates arise.
    """
    w = _spread(windows)
    rows = flushes.drop("agent", "trial").withColumn("_size", F.explode(_levels(w)))
    rows = rows.withColumn("_bucket", F.explode(F.array_distinct(F.transform(times, lambda t: _bucket(t, F.col("_size"))))))

    def inside(t: Column) -> Column:
        return (t >= F.col("_s")) & ((t <= F.col("_e")) if closed else (t < F.col("_e")))

    first = F.array_min(F.filter(times, inside))
    return (rows.join(w, ["_size", "_bucket"])
            .where(_bucket(first, F.col("_size")) == F.col("_bucket"))
            .drop("_size", "_bucket", "_s", "_e", "s_us", "e_us"))


def attribute_flush_events(events: DataFrame, windows: DataFrame, flush_keys=("session", "flush_seq"),
                           closed: bool = True) -> DataFrame:
    """The same from exploded events: (agent, trial, flush keys) once per flush and window.

    Events of a flush are never gathered; repeats collapse before the shuffle.
    """
    rows = attribute_requests(events.select("agent", "trial", "us", *flush_keys), windows, closed)
    return rows.select("agent", "trial", *flush_keys).distinct()


def egress_anomalies(attributed: DataFrame, expected: DataFrame, column: str = "source_ip") -> DataFrame:
    """Attributed records whose address is not among the expected ones."""
    return attributed.join(expected.select(column).distinct(), [column], "left_anti")


SUMMARY_FIELDS = ["source_ip", "ja3", "ja4", "protocol", "h2_fp", "path", "header_order"]


def attribution_values(attributed: DataFrame, fields=None) -> DataFrame:
    """(agent, trial, field, value, n): what each trial showed, one row per value."""
    fields = [f for f in (fields or SUMMARY_FIELDS) if f in attributed.columns]
    long = attributed.select("agent", "trial", F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])))
    return long.where(F.col("value").isNotNull()).groupBy("agent", "trial", "field", "value").agg(
        F.count(F.lit(1)).alias("n"))


def attribution_summary(windows: DataFrame, values: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """One row per window: records, distinct values per field, emptiness and anomaly flags.

    Trials without records stay, since the summary starts from the windows.
    """
    fields = ["source_ip", "ja3", "ja4", "protocol", "h2_fp", "path", "header_order"]
    is_ip = F.col("field") == "source_ip"
    stats = values.groupBy("agent", "trial").agg(
        F.sum(F.when(is_ip, F.col("n"))).alias("record_count"),
        *[F.count_if(F.col("field") == f).alias(f"n_{f}") for f in fields])
    out = windows.join(stats, ["agent", "trial"], "left")
    for c in ["record_count", *[f"n_{f}" for f in fields]]:
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    out = out.withColumn("is_empty", F.col("record_count") == 0)
    if anomalies is not None:
        odd = anomalies.groupBy("agent", "trial").agg(F.count(F.lit(1)).alias("n_anomalies"))
        out = (out.join(odd, ["agent", "trial"], "left")
               .withColumn("n_anomalies", F.coalesce("n_anomalies", F.lit(0))))
    return out


def source_summary(summary: DataFrame) -> DataFrame:
    """Per source: trials, records, empty trials and trials with anomalies."""
    aggs = [F.count(F.lit(1)).alias("trial_count"), F.sum("record_count").alias("record_count"),
            F.count_if("is_empty").alias("empty_trials")]
    if "n_anomalies" in summary.columns:
        aggs.append(F.count_if(F.col("n_anomalies") > 0).alias("anomaly_trials"))
    return summary.groupBy("agent").agg(*aggs)


def fingerprint_union(values: DataFrame, fields=("ja3", "ja4", "protocol")) -> DataFrame:
    """Distinct fingerprint values over all trials of a source."""
    return (values.where(F.col("field").isin(*fields)).groupBy("agent", "field", "value")
            .agg(F.count(F.lit(1)).alias("n_trials"), F.sum("n").alias("n_requests")))
