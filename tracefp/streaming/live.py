"""Structured Streaming forms of ingest, attribution, checkpoints and running sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracefp.functions.events import input_event_monitor
from tracefp.functions.requests import drop_collect_posts, is_page
from tracefp.operators.attribution import attribute_requests
from tracefp.operators.ordered import first_time, ordered_columns, running_count, running_sum
from tracefp.operators.sequences import checkpoint_counts, checkpoint_hits, checkpoint_state
from tracefp.schema import TRIAL_KEY

# ---- ingest --------------------------------------------------------------------


def stream_json(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """New JSON-lines files of a log folder as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def stream_logs(stream: DataFrame, out: str, checkpoint: str, us: str = "us", fmt: str = "parquet",
                available_now: bool = True) -> StreamingQuery:
    """Append a log stream to a table partitioned by UTC date."""
    dated = stream.withColumn("date", F.to_date(F.timestamp_micros(F.col(us))))
    writer = (dated.writeStream.format(fmt).partitionBy("date").option("path", out)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_attribution(stream: DataFrame, windows: DataFrame, closed: bool = True) -> DataFrame:
    """Requests matched to known windows as they arrive (stream-static join on buckets)."""
    return attribute_requests(stream, windows, closed)


def stream_input_monitor(stream: DataFrame) -> DataFrame:
    """Form input and application events; stateless."""
    return input_event_monitor(stream)


# ---- checkpoints -------------------------------------------------------------------

_COUNTERS = "n_int long, n_req long, n_page long, base long, last_path string"
IDLE_MS = 7 * 86_400_000


def _ordered(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """The group's rows of this micro-batch in order; a micro-batch bounds them."""
    return pd.concat(list(batches), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


def stream_checkpoints(stream: DataFrame, every: int = 50, idle_ms: int = IDLE_MS, delay: str = "1 hour") -> DataFrame:
    """Page and event checkpoints of a merged live stream, counters kept per trial.

    The counters are Spark's own keyed state: five values a trial, dropped once
    event time is idle_ms past the trial's last event.  Events are taken in order
    within a micro-batch; late ones count where they arrive, and those later than
    the delay are dropped.
    """
    page = F.coalesce((F.col("kind") == "request") & (F.col("method") == "GET") & is_page(), F.lit(False))
    rows = stream.select(*TRIAL_KEY, "id", "us", (F.col("kind") == "interaction").alias("event"), page.alias("page"),
                         F.coalesce("path", F.lit("")).alias("path"), F.timestamp_micros("us").alias("event_ts")).withWatermark("event_ts", delay)
    kind = stream.schema["id"].dataType.simpleString()
    out_schema = (f"agent string, trial string, id {kind}, us long, checkpoint string, page_index long, event_index long, "
                  "page_path string, n_requests long, n_int_events long")

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n_int, n_req, n_page, base, last_path = state.get if state.exists else (0, 0, 0, 0, "")
        df = _ordered(batches, ["us", "event", "id"])
        event, is_page_row = df["event"].to_numpy(bool), df["page"].to_numpy(bool)
        ints, reqs, pages = n_int + event.cumsum(), n_req + (~event).cumsum(), n_page + is_page_row.cumsum()
        # the last page at or before each row, -1 where it came in an earlier batch
        at = np.maximum.accumulate(np.where(is_page_row, np.arange(len(df)), -1))
        bases = np.where(at >= 0, ints[at], base)
        paths = np.where(at >= 0, df["path"].to_numpy(object)[at], last_path)
        since = ints - bases
        fires = event & (since > 0) & (since % every == 0)
        state.update((int(ints[-1]), int(reqs[-1]), int(pages[-1]), int(bases[-1]), str(paths[-1])))
        state.setTimeoutTimestamp(max(int(df["us"].iloc[-1]) // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        hit = np.nonzero(is_page_row | fires)[0]
        on_page = is_page_row[hit]
        yield pd.DataFrame({
            "agent": key[0], "trial": key[1], "id": df["id"].to_numpy()[hit], "us": df["us"].to_numpy()[hit],
            "checkpoint": np.where(on_page, "page", "event"),
            "page_index": pd.Series(pages[hit]).where(on_page).astype("Int64"),
            "event_index": pd.Series(ints[hit]).where(~on_page).astype("Int64"),
            "page_path": paths[hit], "n_requests": reqs[hit], "n_int_events": ints[hit]})

    return rows.groupBy(*TRIAL_KEY).applyInPandasWithState(step, out_schema, _COUNTERS, "append", GroupStateTimeout.EventTimeTimeout)


TRIAL_COUNTERS = "agent string, trial string, n_int long, n_req long, n_page long, base long, last_path string, last_us long"


def checkpoint_rows(stream: DataFrame) -> DataFrame:
    """What checkpoints need of a merged stream: (keys, id, us, event, page, path); a row
    without a time has no place in it."""
    stream = stream.where("us IS NOT NULL")
    page = F.coalesce((F.col("kind") == "request") & (F.col("method") == "GET") & is_page(), F.lit(False))
    return stream.select(*TRIAL_KEY, "id", "us", F.coalesce(F.col("kind") == "interaction", F.lit(False)).alias("event"), page.alias("page"), "path")


def write_checkpoints(stream: DataFrame, out: str, checkpoint: str, every: int = 50, idle_ms: int = IDLE_MS, delay_ms: int = 3_600_000,
                      slice_us: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Checkpoints of a merged live stream in a table, with state on two levels.

    Within a micro-batch rows are counted per (trial, time slice), so a trial with a third
    of all rows is as many groups as it has slices; between micro-batches one row of
    counters per trial is carried.  Both are written to shared folders: checkpoints of
    micro-batch k to ``out``/batch=k, counters to one of two tables in ``checkpoint`` in
    turn, so a micro-batch that runs again reads what it read before and replaces what it
    wrote.  Rows are taken in order within a micro-batch; late ones count where they
    arrive, those later than delay_ms behind earlier micro-batches are dropped, and the
    counters of a trial are dropped idle_ms after its last row.
    """
    def step(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        state = spark.read.schema(TRIAL_COUNTERS).parquet(f"{checkpoint}/trials-{(k - 1) % 2}") if k else spark.createDataFrame([], TRIAL_COUNTERS)
        mark = state.agg(F.max("last_us")).first()[0]
        rows = batch if mark is None else batch.where(F.col("us") >= mark - delay_ms * 1000)
        counted = checkpoint_counts(rows, state, slice_us=slice_us).persist(StorageLevel.DISK_ONLY)
        checkpoint_hits(counted, every).write.mode("overwrite").parquet(f"{out}/batch={k}")
        left = checkpoint_state(counted)
        left = left if mark is None else left.where(F.col("last_us") >= mark - idle_ms * 1000)
        left.write.mode("overwrite").parquet(f"{checkpoint}/trials-{k % 2}")
        counted.unpersist()

    writer = checkpoint_rows(stream).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# ---- running sums -------------------------------------------------------------------------

RUNNING_SHARES = {
    "sf_site_none_rate": "sf_site_none", "sf_violation_rate": "sf_any_violation",
    "headless_rate": "ch_is_headless", "ch_incoherence_rate": "ch_any_incoherence",
    "ch_brand_matches_rate": "ch_brand_matches_ua", "ch_mobile_matches_rate": "ch_mobile_matches_ua",
    "ch_platform_matches_rate": "ch_platform_matches_ua", "accept_lang_rate": "has_accept_language",
    "has_priority_rate": "has_priority", "has_sec_ch_ua_rate": "has_sec_ch_ua",
    "has_nonstandard_rate": "has_nonstandard_headers", "n_headers_mean": "n_headers",
    "f1_frac_kyber768": "has_kyber768", "f1_frac_mlkem768": "has_mlkem768",
    "f2_frac_firefox_ja4": "is_firefox_ja4", "f2_frac_h2": "is_h2", "f2_frac_pq": "has_pq",
    "f3_frac_win_firefox": "win_is_firefox", "f8_mean_cipher_count": "cipher_count",
    "f8_mean_curve_count": "curve_count", "f10_frac_ext16": "is_ext16", "f10_frac_ext17": "is_ext17",
}


def signal_frame(requests: DataFrame) -> DataFrame:
    """Per request but collect posts, the numbers whose means are the running features."""
    from tracefp.plans.http import header_frame
    from tracefp.plans.tls import fingerprint_frame

    df = fingerprint_frame(header_frame(drop_collect_posts(requests))).withColumn("sf_site_none", F.col("sf_site") == "none")
    return df.select(*TRIAL_KEY, "id", "us", is_page().alias("page"), *[F.col(c).cast("int").cast("double").alias(n)
                                         for n, c in RUNNING_SHARES.items()])


def running_sums(signals: DataFrame) -> DataFrame:
    """Sums and count per trial: partial state that merges by addition."""
    return signals.groupBy(*TRIAL_KEY).agg(
        F.count(F.lit(1)).alias("n_requests"), F.min("us").alias("start_us"), F.max("us").alias("last_us"),
        *[F.sum(c).alias(c) for c in RUNNING_SHARES])


def running_features(sums: DataFrame) -> DataFrame:
    """Means, request rate and log size from the sums; equal to the batch features."""
    seconds = (F.col("last_us") - F.col("start_us")) / 1e6
    return sums.select(
        *TRIAL_KEY, *[c for c in ("id",) if c in sums.columns], *[(F.col(c) / F.col("n_requests")).alias(c) for c in RUNNING_SHARES],
        F.when(seconds > 0, F.col("n_requests") / seconds).otherwise(0.0).alias("req_rate_hz"),
        F.log1p("n_requests").alias("log_n_requests"))


def stream_running_sums(requests: DataFrame, idle_ms: int = IDLE_MS, delay: str = "1 hour") -> DataFrame:
    """The sums of a trial at each of its page requests, as they arrive.

    Spark's own keyed state holds one row of sums a trial, dropped once event time
    is idle_ms past the trial's last request; requests later than the delay are
    dropped.
    """
    names = list(RUNNING_SHARES)
    numbers = ", ".join(f"{n} double" for n in names)
    signals = signal_frame(requests).withColumn("event_ts", F.timestamp_micros("us")).withWatermark("event_ts", delay)
    kind = signals.schema["id"].dataType.simpleString()

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, start, last, *sums = state.get if state.exists else (0, None, 0, *[0.0] * len(names))
        df = _ordered(batches, ["us", "id"])
        us = df["us"].to_numpy(np.int64)
        starts = np.minimum.accumulate(us)
        starts = starts if start is None else np.minimum(starts, start)
        lasts = np.maximum(np.maximum.accumulate(us), last)
        counts = n + np.arange(1, len(df) + 1)
        totals = df[names].fillna(0.0).to_numpy(float).cumsum(0) + np.array(sums)
        state.update((int(counts[-1]), int(starts[-1]), int(lasts[-1]), *map(float, totals[-1])))
        state.setTimeoutTimestamp(max(int(us[-1]) // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        hit = np.nonzero(df["page"].to_numpy(bool))[0]
        yield pd.DataFrame({"agent": key[0], "trial": key[1], "id": df["id"].to_numpy()[hit], "n_requests": counts[hit],
                            "start_us": starts[hit], "last_us": lasts[hit], **{c: totals[hit, k] for k, c in enumerate(names)}})

    return signals.groupBy(*TRIAL_KEY).applyInPandasWithState(
        step, f"agent string, trial string, id {kind}, n_requests long, start_us long, last_us long, {numbers}",
        f"n long, start_us long, last_us long, {numbers}", "append", GroupStateTimeout.EventTimeTimeout)


def _running_state(id_type: str) -> tuple[str, str]:
    """Columns of the given-out rows and of a trial's sums."""
    numbers = ", ".join(f"{n} double" for n in RUNNING_SHARES)
    return tuple(f"agent string, trial string, {own}n_requests long, start_us long, last_us long, {numbers}" for own in (f"id {id_type}, ", ""))


def running_rows(signals: DataFrame, state: DataFrame, slice_us: int | None = None) -> DataFrame:
    """The sums at each page request of ``signals``, counted on from ``state``, the sums of
    earlier requests.  A trial is summed slice by slice; one row a slice meets its state.
    The signals are whole numbers, so the sums are exact in any order."""
    names = list(RUNNING_SHARES)
    # requests of one microsecond go by id, those without one last
    rows = signals.withColumn("_tie", F.struct(F.col("id").isNull().alias("none"), "id"))
    summed = ordered_columns(rows, running_count("_n"), first_time("_start"), *[running_sum(f"_s_{c}", F.col(c)) for c in names],
                             tie="_tie", slice_us=slice_us).where("page")
    before = state.withColumnsRenamed({c: f"_b_{c}" for c in state.columns})
    same = F.col("agent").eqNullSafe(F.col("_b_agent")) & F.col("trial").eqNullSafe(F.col("_b_trial"))
    zero = F.lit(0)
    return summed.join(before, same, "left").select(
        *TRIAL_KEY, "id", (F.col("_n") + F.coalesce("_b_n_requests", zero)).alias("n_requests"), F.least("_start", "_b_start_us").alias("start_us"),
        F.greatest("us", "_b_last_us").alias("last_us"), *[(F.col(f"_s_{c}") + F.coalesce(f"_b_{c}", zero)).cast("double").alias(c) for c in names])


def write_running_sums(requests: DataFrame, out: str, checkpoint: str, idle_ms: int = IDLE_MS, delay_ms: int = 3_600_000,
                       slice_us: int | None = None, available_now: bool = True) -> StreamingQuery:
    """The sums of ``stream_running_sums`` in a table, without a Python step per trial.

    Within a micro-batch requests are summed per (trial, time slice); between micro-batches
    one row of sums per trial is carried, in one of two tables in ``checkpoint`` in turn,
    so a micro-batch that runs again reads what it read before and replaces what it wrote.
    Rows of micro-batch k go to ``out``/batch=k.  Requests later than delay_ms behind
    earlier micro-batches, and those without a time, are dropped, and so are a trial's
    sums idle_ms after its last request, by the same measure of time.
    """
    signals = signal_frame(requests).where("us IS NOT NULL")
    _, kept = _running_state(signals.schema["id"].dataType.simpleString())

    def step(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        state = spark.read.schema(kept).parquet(f"{checkpoint}/sums-{(k - 1) % 2}") if k else spark.createDataFrame([], kept)
        top = state.agg(F.max("last_us")).first()[0]
        mark = None if top is None else top - delay_ms * 1000
        rows = (batch if mark is None else batch.where(F.col("us") >= mark)).persist(StorageLevel.DISK_ONLY)
        running_rows(rows, state, slice_us).write.mode("overwrite").parquet(f"{out}/batch={k}")
        left = state.unionByName(running_sums(rows)).groupBy(*TRIAL_KEY).agg(
            F.sum("n_requests").alias("n_requests"), F.min("start_us").alias("start_us"), F.max("last_us").alias("last_us"),
            *[F.sum(c).alias(c) for c in RUNNING_SHARES])
        left = left if mark is None else left.where(F.col("last_us") >= mark - idle_ms * 1000)
        left.write.mode("overwrite").parquet(f"{checkpoint}/sums-{k % 2}")
        rows.unpersist()

    writer = signals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_running_sums(spark: SparkSession, out: str, id_type: str = "long") -> DataFrame:
    return spark.read.schema(_running_state(id_type)[0]).parquet(out).drop("batch")
