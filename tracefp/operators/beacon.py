"""Removal of instrumentation posts that are not browsing traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefp.functions.requests import is_collect_post, is_page
from tracefp.operators.ordered import halo_slices
from tracefp.operators.sequences import request_intervals
from tracefp.schema import BURST_WINDOW_MS, TRIAL_KEY, UNLOAD_WINDOW_MS


def burst_neighbour(df: DataFrame, burst_ms: int = BURST_WINDOW_MS, keys=TRIAL_KEY,
                    slice_us=None) -> DataFrame:
    """Collect posts with a flag: another one of the trial lies within ±burst_ms.

    Only the nearest post on either side can decide, so no frame is counted.
    """
    reach = int(burst_ms * 1000)
    rows, cut, home = halo_slices(df.where(is_collect_post()), reach, slice_us=slice_us)
    w = Window.partitionBy(*keys, cut).orderBy("us", "id")
    near = ((F.col("us") - F.lag("us").over(w) <= reach) | (F.lead("us").over(w) - F.col("us") <= reach))
    return (rows.withColumn("in_burst", F.coalesce(near, F.lit(False)))
            .where(home).drop(cut, home))


def _tested(df: DataFrame, unload_ms, burst_ms, aggressive, keys, slice_us) -> DataFrame:
    """Collect posts and page requests with is_beacon.

    Both conditions look only a bounded time away, so rows near a slice edge
    are copied into the next slice and one shuffle on (trial, slice) answers
    both.  Nearest neighbours decide them, found by frames that grow from one
    end and are evaluated incrementally.
    """
    unload, burst = int(unload_ms * 1000), int(burst_ms * 1000)
    post, page, us = is_collect_post(), is_page(), F.col("us")
    rows, cut, home = halo_slices(df.where(post | page), max(unload, burst), slice_us=slice_us)
    part = Window.partitionBy(*keys, cut)
    before = part.orderBy("us", "id").rowsBetween(Window.unboundedPreceding, -1)
    after = part.orderBy(us.desc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = part.orderBy(us.desc()).rangeBetween(Window.unboundedPreceding, -1)

    def nearest(frame):
        return F.last(F.when(post, us), ignorenulls=True).over(frame)

    followed = F.min(F.when(page, us)).over(later) - us <= unload
    crowd = (us - nearest(before) <= burst) | (nearest(after) - us <= burst)
    named = F.col("referer").rlike(r"\.html$")
    hit = post & followed & (F.lit(bool(aggressive)) | F.coalesce(crowd, F.lit(False))
                             | F.coalesce(named, F.lit(False)))
    return rows.withColumn("is_beacon", F.coalesce(hit, F.lit(False))).where(home).drop(cut, home)


def beacon_flags(df: DataFrame, unload_ms: int = UNLOAD_WINDOW_MS,
                 burst_ms: int = BURST_WINDOW_MS, aggressive: bool = False,
                 keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Collect posts with is_beacon.

    A post is a beacon when a page request follows within unload_ms and it
    either has a neighbour post within burst_ms or names a page as referer; in
    aggressive mode the first condition alone decides.
    """
    narrow = df.select(*keys, "id", "us", "method", "path", "referer")
    return (_tested(narrow, unload_ms, burst_ms, aggressive, keys, slice_us)
            .where(is_collect_post()).select(*keys, "id", "us", "is_beacon"))


def beacon_ids(df: DataFrame, **kw) -> DataFrame:
    """Keys and ids of the posts that the filter removes."""
    return beacon_flags(df, **kw).where("is_beacon").select(*kw.get("keys", TRIAL_KEY), "id")


def beacon_filter(df: DataFrame, unload_ms: int = UNLOAD_WINDOW_MS,
                  burst_ms: int = BURST_WINDOW_MS, aggressive: bool = False,
                  keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Requests without beacons; rows that can neither be removed nor decide a
    removal are not shuffled for it."""
    kept = (_tested(df, unload_ms, burst_ms, aggressive, keys, slice_us)
            .where(~F.col("is_beacon")).drop("is_beacon"))
    return kept.unionByName(df.where(~(is_collect_post() | is_page())))


def beacon_filter_with_intervals(df: DataFrame, **kw) -> DataFrame:
    """The filter followed by fresh elapsed and inter-request times."""
    return request_intervals(beacon_filter(df, **kw), keys=kw.get("keys", TRIAL_KEY),
                             slice_us=kw.get("slice_us"))


def filter_report(df: DataFrame, flags: DataFrame, keys=TRIAL_KEY) -> DataFrame:
    """Raw, removed and kept counts per trial; both inputs are counted before they meet."""
    raw = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_raw"),
                                F.count_if(F.col("method") == "POST").alias("collect_posts_raw"))
    cut = flags.where("is_beacon").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_removed"))
    out = raw.join(cut, list(keys), "left").withColumn(
        "n_removed", F.coalesce("n_removed", F.lit(0)))
    return (out.withColumn("n_filtered", F.col("n_raw") - F.col("n_removed"))
            .withColumn("collect_posts_kept", F.col("collect_posts_raw") - F.col("n_removed")))
