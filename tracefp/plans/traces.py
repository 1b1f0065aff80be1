"""Per-trial and per-client request statistics and the trace report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefp.functions.requests import is_page, is_subresource, request_flags
from tracefp.operators.beacon import beacon_filter
from tracefp.operators.ordered import next_time, ordered_columns, previous, prior_time
from tracefp.operators.quantiles import grouped_quantiles
from tracefp.operators.sequences import burst_spread, page_attribution, trial_ordinal
from tracefp.schema import TRIAL_KEY
from tracefp.session import materialize


def union_traces(*frames: DataFrame) -> DataFrame:
    """All trials of all clients in one table; columns may differ."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _rate(n, seconds):
    return F.when(seconds > 0, n / seconds).otherwise(0.0)


def _request_timeline(df: DataFrame, keys, slice_us, subresources: bool = False) -> DataFrame:
    """Requests with the gaps the statistics need, all from one slice pass.

    Gaps are whole microseconds, so their means do not depend on row order.  The
    narrow timeline is written once: moments and exact medians both read it.
    """
    specs = [previous("_prev", F.col("us")), previous("_page", F.col("us"), is_page())]
    if subresources:
        specs += [next_time("_subres", is_subresource()), prior_time("page_us", is_page())]
    rows = df.select(*keys, "id", "us", "method", "path", "processing_ms", "sf_mode", "sf_dest")
    timed = request_flags(ordered_columns(rows, *specs, keys=keys, slice_us=slice_us))
    timed = (timed.withColumn("gap_us", F.col("us") - F.col("_prev"))
             .withColumn("dwell_us", F.when(F.col("is_page"), F.col("us") - F.col("_page"))))
    if subresources:
        timed = timed.withColumn("p2s_us", F.when(F.col("is_page"), F.col("_subres") - F.col("us")))
    spare = ("id", "sf_mode", "sf_dest", "is_subres", "is_fetch", "_prev", "_page", "_subres")
    return materialize(timed.drop(*spare), "timeline")


def _temporal_group() -> list:
    duration = (F.max("us") - F.min("us")) / 1e6
    return [
        F.count(F.lit(1)).alias("n_requests"),
        F.count_if("is_page").alias("n_pages"),
        F.count_if("is_collect").alias("n_collect_posts"),
        duration.alias("duration_s"),
        _rate(F.count(F.lit(1)), duration).alias("req_rate_hz"),
        (F.avg("gap_us") / 1e3).alias("iri_mean_ms"),
        (F.stddev_samp("gap_us") / 1e3).alias("iri_std_ms"),
        F.avg("processing_ms").alias("proc_mean_ms"), F.max("processing_ms").alias("proc_max_ms"),
        (F.avg("dwell_us") / 1e6).alias("page_dwell_mean_s"),
        (F.max("dwell_us") / 1e6).alias("page_dwell_max_s"),
        (F.stddev_samp("dwell_us") / 1e6).alias("page_dwell_std_s")]


def _iri_median(timed: DataFrame, keys) -> DataFrame:
    q = grouped_quantiles(timed, keys, "gap_us", {"_median": 0.5})
    return q.select(*keys, (F.col("_median") / 1e3).alias("iri_median_ms"))


def trace_temporal_stats(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Counts, duration, rate, interval, processing and dwell statistics per trial.

    The first request of a trial has no interval.
    """
    keys = list(keys)
    timed = _request_timeline(df, keys, slice_us)
    return timed.groupBy(*keys).agg(*_temporal_group()).join(_iri_median(timed, keys), keys, "left")


def page_spatial_stats(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Per page of a trial: requests, collects, body bytes and mean processing time."""
    rows = request_flags(page_attribution(df, keys, slice_us)).where(F.col("page").isNotNull())
    return rows.groupBy(*keys, "page").agg(
        F.count(F.lit(1)).alias("n_requests"), F.count_if("is_collect").alias("n_collect"),
        F.sum("body_size").alias("total_body_bytes"), F.max("body_size").alias("max_body_bytes"),
        F.avg("processing_ms").alias("mean_proc_ms"))


def body_size_by_page(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Body-size statistics of collect posts per page of a trial."""
    keys = list(keys)
    rows = (page_attribution(df, keys, slice_us)
            .where((F.col("path") == "/collect") & (F.col("method") == "POST")
                   & F.col("page").isNotNull()))
    stats = rows.groupBy(*keys, "page").agg(
        F.count(F.lit(1)).alias("n_posts"), F.avg("body_size").alias("mean"),
        F.stddev_samp("body_size").alias("std"), F.min("body_size").alias("min"),
        F.max("body_size").alias("max"))
    return stats.join(grouped_quantiles(rows, [*keys, "page"], "body_size", {"median": 0.5}),
                      [*keys, "page"], "left")


def body_size_rollup(per_page: DataFrame) -> DataFrame:
    """Body-size statistics per page over trials."""
    stats = per_page.groupBy("page").agg(
        F.sum("n_posts").alias("n_posts"), F.avg("mean").alias("mean"),
        F.stddev_samp("mean").alias("std"), F.min("min").alias("min"), F.max("max").alias("max"))
    return stats.join(grouped_quantiles(per_page, ["page"], "median", {"median": 0.5}),
                      ["page"], "left")


SUMMARY_METRICS = ["n_requests", "n_pages", "n_collect_posts", "duration_s", "req_rate_hz",
                   "iri_mean_ms", "iri_median_ms", "iri_std_ms", "proc_mean_ms", "proc_max_ms",
                   "page_dwell_mean_s", "page_dwell_max_s"]


def mean_std_by_metric(df: DataFrame, metrics: list[str], keys=()) -> DataFrame:
    """(metric, mean, std, n) over the rows, in long form."""
    long = df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in metrics])))
    return long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.count("value").alias("n"))


def trace_summary_mean_std(stats: DataFrame) -> DataFrame:
    return mean_std_by_metric(stats, SUMMARY_METRICS)


def page_visit_rollup(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Trials that visit each page and mean requests per visit."""
    rows = page_attribution(df, keys, slice_us).where(F.col("page").isNotNull())
    visits = rows.groupBy(*keys, "page").agg(F.count(F.lit(1)).alias("n"))
    return visits.groupBy("page").agg(F.count(F.lit(1)).alias("visits"),
                                      F.avg("n").alias("req_per_visit"))


def trace_fingerprint_counts(df: DataFrame, keys=TRIAL_KEY) -> DataFrame:
    """Distinct fingerprints and agents per trial, and the first JA3."""
    return df.groupBy(*keys).agg(
        F.countDistinct("ja3").alias("ja3_unique"), F.countDistinct("ja4").alias("ja4_unique"),
        F.countDistinct("ua").alias("ua_unique"),
        F.min(F.struct("us", "id", "ja3"))["ja3"].alias("ja3_first"))


def temporal_trial_features(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Rate, interval and dwell features plus page-to-subresource timing per trial."""
    keys = list(keys)
    timed = _request_timeline(df, keys, slice_us, subresources=True)
    base = timed.groupBy(*keys).agg(*_temporal_group(), (F.avg("p2s_us") / 1e3).alias("iri_page_to_subres_ms"))
    out = base.join(_iri_median(timed, keys), keys, "left").select(
        *keys, "req_rate_hz",
        F.coalesce("iri_median_ms", F.lit(0.0)).alias("iri_median_ms"),
        F.when(F.col("n_requests") > 1, F.col("iri_std_ms")).otherwise(0.0).alias("iri_std_ms"),
        F.coalesce("page_dwell_mean_s", F.lit(0.0)).alias("page_dwell_mean_s"),
        F.when(F.col("n_pages") > 1, F.col("page_dwell_std_s")).otherwise(0.0).alias("page_dwell_std_s"),
        "iri_page_to_subres_ms")
    return out.join(burst_spread(timed, keys), keys, "left")


def agent_rate_dispersion(features: DataFrame) -> DataFrame:
    """Median and coefficient of variation of the trial rates of each client.

    A report only: both are constant per client and would leak the label.
    """
    stats = features.groupBy("agent").agg(
        F.when(F.avg("req_rate_hz") > 0, F.stddev_samp("req_rate_hz") / F.avg("req_rate_hz"))
        .otherwise(0.0).alias("req_rate_hz_cv"))
    return stats.join(grouped_quantiles(features, ["agent"], "req_rate_hz",
                                        {"req_rate_hz_median": 0.5}), ["agent"], "left")


def agent_feature_summary(features: DataFrame) -> DataFrame:
    """Mean and standard deviation of every numeric feature per client, four decimals."""
    numeric = [c for c, t in features.dtypes
               if t in ("int", "bigint", "double", "float") and c not in ("agent", "trial")]
    return features.groupBy("agent").agg(
        *[F.round(F.avg(c), 4).alias(f"{c}_mean") for c in numeric],
        *[F.round(F.stddev_samp(c), 4).alias(f"{c}_std") for c in numeric])


def agent_rate_matrix(stats: DataFrame) -> DataFrame:
    """Every trial rate of a client with its number and the client's variation.

    Long form: a client may have any number of trials.
    """
    rates = trial_ordinal(stats.select("agent", "trial", "req_rate_hz"))
    cv = stats.groupBy("agent").agg(
        (F.stddev_samp("req_rate_hz") / F.nullif(F.avg("req_rate_hz"), F.lit(0.0))).alias("rate_cv"))
    return rates.join(cv, ["agent"])


def pivot_rate_matrix(matrix: DataFrame, n_trials: int) -> DataFrame:
    """The first n_trials rates of each client as columns."""
    return (matrix.groupBy("agent").pivot("idx", list(range(1, n_trials + 1)))
            .agg(F.first("req_rate_hz")))


def agent_interval_means(stats: DataFrame, prefix: str) -> DataFrame:
    """Mean over trials of the interval mean and standard deviation, in seconds."""
    return stats.groupBy("agent").agg(
        (F.avg(f"{prefix}_mean_ms") / 1000.0).alias(f"{prefix}_mean_s"),
        (F.avg(f"{prefix}_std_ms") / 1000.0).alias(f"{prefix}_std_s"))


def interval_histogram(intervals: DataFrame, value: str, quantile: float, bins: int,
                       keys=TRIAL_KEY) -> DataFrame:
    """Histogram of intervals clipped at a quantile, per trial.

    The quantile is over all rows including the leading zero; the first row of
    a trial is left out of the bins.  The last bin is closed on both sides.
    """
    keys = list(keys)
    intervals = materialize(intervals.select(*keys, value, "is_first"), "intervals")
    clip = grouped_quantiles(intervals, keys, value, {"_clip": quantile})
    rows = (intervals.where(~F.col("is_first")).join(clip, keys)
            .select(*keys, F.least(F.col(value), F.col("_clip")).alias("_v")))
    return histogram(rows, "_v", bins, keys)


def histogram(rows: DataFrame, value: str, bins: int, keys=()) -> DataFrame:
    """Equal-width bins between the smallest and largest value of each key.

    A key whose values are all equal gets a range of one around the value.
    """
    keys = list(keys) or ["_all"]
    src = rows if "_all" not in keys else rows.withColumn("_all", F.lit(1))
    counts = (src.where(F.col(value).isNotNull())
              .groupBy(*keys, F.col(value).cast("double").alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n")))
    span = counts.groupBy(*keys).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"))
    flat = F.col("_hi") == F.col("_lo")
    span = (span.withColumn("_hi", F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")))
            .withColumn("_lo", F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo"))))
    at = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    out = (counts.join(span, keys).withColumn("bin", F.least(at, F.lit(bins - 1)).cast("int"))
           .groupBy(*keys, "bin").agg(F.sum("_n").alias("n"), F.max("mean").alias("mean")))
    return out.drop("_all")


def trace_report(requests: DataFrame, slice_us=None, **filter_args) -> DataFrame:
    """The request report from raw rows: filter, reduce per trial, reduce over trials."""
    kept = beacon_filter(requests, slice_us=slice_us, **filter_args)
    return trace_summary_mean_std(trace_temporal_stats(kept, slice_us=slice_us))


