"""The beacon filter applied to a live stream: posts are held until both windows have
passed in event time, then kept or dropped; every other request passes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tracefp.functions.requests import is_collect_post, is_page
from tracefp.operators.ordered import halo_slices
from tracefp.schema import BURST_WINDOW_MS, TRIAL_KEY, UNLOAD_WINDOW_MS
from tracefp.streaming.store import typed_state

DECIDED = "is_beacon boolean, request string"
BUCKETS = 256


class HeldPosts(StatefulProcessor):
    """Posts of one (time slice, bucket of trials) that wait, and the times that can decide them.

    Lists grow by appending; they are read when a timer fires, and then hold only what
    a later decision may still look at.  The trials of a bucket share its lists and its
    timer; a row names its trial by `place`, and all are decided in one vectorised step.
    """

    def __init__(self, unload_us: int, burst_us: int, aggressive: bool) -> None:
        self.unload, self.burst, self.aggressive = unload_us, burst_us, aggressive
        self.reach = max(unload_us, burst_us)

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "place string, us long, named boolean, request string")
        self.near = handle.getListState("near", "place string, us long, page boolean")

    def close(self) -> None:
        pass

    def _wake(self, at_us: int, timers) -> None:
        """One timer a key, the earliest asked for; one that is firing is still listed."""
        mark = timers.getCurrentWatermarkInMs()
        at = max(at_us // 1000 + 1, mark + 1)
        waiting = [t for t in self.handle.listTimers() if t > mark]
        if not waiting or at < min(waiting):
            for t in waiting:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for df in rows:
            df = df[~df["heartbeat"]]
            if not len(df):
                continue
            self.near.appendList(list(zip(df["place"].tolist(), df["us"].tolist(), df["page"].tolist())))
            posts = df[~df["page"] & df["home"]]
            if len(posts):
                self.open.appendList(list(zip(*[posts[c].tolist() for c in ("place", "us", "named", "request")])))
            low = int(posts["us"].min()) + self.reach if len(posts) else int(df["us"].max()) + 2 * self.reach
            first = low if first is None else min(first, low)
        if first is not None:
            self._wake(first, timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held, near = list(self.open.get()), list(self.near.get())
        us, seen = np.array([x[1] for x in held], np.int64), np.array([x[1] for x in near], np.int64)
        page = np.array([x[2] for x in near], bool)
        # the times of a place are moved clear of all others': a window ends inside its own place
        place = pd.factorize(np.array([x[0] for x in (*held, *near)], object))[0].astype(np.int64)
        low = min(us.min(initial=mark), seen.min(initial=mark))
        span = max(us.max(initial=low), seen.max(initial=low)) - low + 2 * self.reach + 1
        at, seen_at = us - low + place[:len(us)] * span, seen - low + place[len(us):] * span
        pages, posts = np.sort(seen_at[page]), np.sort(seen_at[~page])
        due = us + self.reach < mark
        followed = pages.searchsorted(at + self.unload, "right") > pages.searchsorted(at, "right")
        crowd = posts.searchsorted(at + self.burst, "right") - posts.searchsorted(at - self.burst, "left") > 1
        beacon = followed & (self.aggressive | crowd | np.array([x[2] for x in held], bool))
        left = [x for x, d in zip(held, due) if not d]
        # what an open post, or one that may still come, looks back at
        since = min([mark, *[x[1] for x in left]]) - self.reach
        kept = [x for x in near if x[1] >= since]
        for state, items in ((self.open, left), (self.near, kept)):
            state.put(items) if items else state.clear()
        if left:
            self._wake(min(x[1] for x in left) + self.reach, timerValues)
        elif kept:
            self._wake(max(x[1] for x in kept) + 2 * self.reach, timerValues)
        decided = np.nonzero(due)[0]
        if len(decided):
            yield pd.DataFrame({"is_beacon": beacon[decided], "request": [held[i][3] for i in decided]})


def stream_beacon_decisions(stream: DataFrame, unload_ms: int = UNLOAD_WINDOW_MS, burst_ms: int = BURST_WINDOW_MS, aggressive: bool = False,
                            delay: str = "10 minutes", slice_us: int = 60_000_000, heartbeat: Column | None = None,
                            buckets: int = BUCKETS) -> DataFrame:
    """Every collect post, whole, with is_beacon, once event time has passed its windows.

    State is kept per (time slice, bucket of trials); rows near a slice edge are copied
    to the neighbour, so no key holds more of a trial than one slice.  A key costs the
    same calls however many trials it holds, so keys grow with the slices, not with the
    trials; more buckets make smaller keys and never change the result.  Rows that are
    heartbeats only carry event time: one at the end of the input, later than the last
    post by the windows and the delay, lets the last posts be decided.
    """
    typed_state(stream.sparkSession)
    unload, burst = int(unload_ms * 1000), int(burst_ms * 1000)
    beat = F.lit(False) if heartbeat is None else F.coalesce(heartbeat, F.lit(False))
    near = stream.withColumn("heartbeat", beat).where(F.col("heartbeat") | is_collect_post() | is_page()).select(
        *TRIAL_KEY, "us", is_page().alias("page"), F.coalesce(F.col("referer").rlike(r"\.html$"), F.lit(False)).alias("named"), "heartbeat",
        F.when(is_collect_post(), F.to_json(F.struct(*[F.col(c) for c in stream.columns]))).alias("request"),
        F.timestamp_micros("us").alias("event_ts")).withWatermark("event_ts", delay)
    rows, cut, home = halo_slices(near, max(unload, burst), slice_us=slice_us)
    # names with a leading underscore do not reach the processor
    rows = rows.withColumnsRenamed({cut: "slice", home: "home"})
    rows = rows.withColumn("place", F.to_json(F.struct(*TRIAL_KEY))).withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets)))
    decided = rows.drop(*TRIAL_KEY).groupBy("slice", "bucket").transformWithStateInPandas(HeldPosts(unload, burst, aggressive), DECIDED, "Append", "EventTime")
    return decided.select("is_beacon", F.from_json("request", stream.schema).alias("r")).select("r.*", "is_beacon")


def stream_beacon_filter(stream: DataFrame, unload_ms: int = UNLOAD_WINDOW_MS, burst_ms: int = BURST_WINDOW_MS, aggressive: bool = False,
                         delay: str = "10 minutes", slice_us: int = 60_000_000, heartbeat: Column | None = None,
                         buckets: int = BUCKETS) -> DataFrame:
    """The live requests without beacons, as the batch filter gives them."""
    beat = F.lit(False) if heartbeat is None else F.coalesce(heartbeat, F.lit(False))
    posts = stream_beacon_decisions(stream, unload_ms, burst_ms, aggressive, delay, slice_us, heartbeat, buckets)
    return stream.where(~is_collect_post() & ~beat).unionByName(posts.where(~F.col("is_beacon")).drop("is_beacon"))
