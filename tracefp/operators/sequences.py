"""Interval, carry-forward and as-of operators inside a trial."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefp.functions.events import is_page_load
from tracefp.functions.requests import is_collect_post, is_page, is_subresource, page_name
from tracefp.operators.ordered import (first_time, next_time, ordered_columns, previous,
                                       prior_time, running_count, running_sum)
from tracefp.schema import TRIAL_KEY

MS = 1000.0
SECOND = 1_000_000.0


def request_intervals(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """elapsed_s since the trial began and iri_ms since the previous request (first = 0)."""
    out = ordered_columns(df, first_time("_start"), previous("_prev", F.col("us")),
                          keys=keys, slice_us=slice_us)
    return (out.withColumn("elapsed_s", (F.col("us") - F.col("_start")) / SECOND)
            .withColumn("iri_ms", F.coalesce((F.col("us") - F.col("_prev")) / MS, F.lit(0.0)))
            .withColumn("is_first", F.col("_prev").isNull())
            .drop("_start", "_prev"))


def page_attribution(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """The last page name carried forward onto every later request."""
    name = page_name()
    return ordered_columns(df, previous("page", name, name.isNotNull(), include_self=True),
                           keys=keys, slice_us=slice_us)


def page_dwell(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Page requests with the seconds since the previous page request."""
    pages = df.where(is_page()).select(*keys, "id", "us", "path")
    out = ordered_columns(pages, previous("_prev", F.col("us")), keys=keys, slice_us=slice_us)
    return out.withColumn("dwell_s", (F.col("us") - F.col("_prev")) / SECOND).drop("_prev")


def event_intervals(df: DataFrame, keys=TRIAL_KEY, clip=False, slice_us=None) -> DataFrame:
    """ms_rel since the trial began and iei_ms since the previous event (first = 0)."""
    out = ordered_columns(df, first_time("_start"), previous("_prev", F.col("us")),
                          keys=keys, slice_us=slice_us)
    gap = F.coalesce((F.col("us") - F.col("_prev")) / MS, F.lit(0.0))
    return (out.withColumn("ms_rel", (F.col("us") - F.col("_start")) / MS)
            .withColumn("iei_ms", F.greatest(gap, F.lit(0.0)) if clip else gap)
            .withColumn("is_first", F.col("_prev").isNull())
            .drop("_start", "_prev"))


def next_page_gap(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Milliseconds from each collect post to the strictly next page request."""
    rows = df.where(is_page() | is_collect_post())
    out = ordered_columns(rows, next_time("_next", is_page()), keys=keys, slice_us=slice_us)
    return (out.where(is_collect_post())
            .withColumn("gap_ms", (F.col("_next") - F.col("us")) / MS).drop("_next"))


def page_to_subresource(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Mean gap from a page request to the first later subresource, per trial."""
    rows = df.where(is_page() | is_subresource())
    out = ordered_columns(rows, next_time("_next", is_subresource()), keys=keys, slice_us=slice_us)
    return (out.where(is_page()).groupBy(*keys)
            .agg((F.avg(F.col("_next") - F.col("us")) / MS).alias("iri_page_to_subres_ms")))


def burst_spread(timed: DataFrame, keys=TRIAL_KEY) -> DataFrame:
    """Mean spread of the subresource times after each `page_us`, when there are two."""
    spread = (timed.where(is_subresource() & F.col("page_us").isNotNull())
              .groupBy(*keys, "page_us")
              .agg(F.count(F.lit(1)).alias("n"), (F.max("us") - F.min("us")).alias("spread_us")))
    return spread.groupBy(*keys).agg(
        (F.avg(F.when(F.col("n") >= 2, F.col("spread_us"))) / MS).alias("subresource_burst_ms"))


def subresource_burst(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """How far the subresource requests of a page lie apart, on average per trial."""
    rows = df.where(is_page() | is_subresource())
    return burst_spread(ordered_columns(rows, prior_time("page_us", is_page()), keys=keys,
                                        slice_us=slice_us), keys)


def _gap_stats(df: DataFrame, keys, name: str) -> DataFrame:
    """Mean, standard deviation and number of the gaps to `_next`; whole
    microseconds are summed, so the mean does not depend on the order."""
    rows = df.withColumn("_gap", F.col("_next") - F.col("us"))
    return rows.groupBy(*keys).agg((F.avg("_gap") / MS).alias(f"{name}_mean_ms"),
                                   (F.stddev_samp("_gap") / MS).alias(f"{name}_std_ms"),
                                   F.count("_gap").alias(f"{name}_n"))


def focus_to_input(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Gap from each focus to the first later input on the same element."""
    return _gap_stats(focus_ends(df, keys, slice_us), keys, "focus_to_input")


def focus_ends(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Each focus with the time of the first later input on the same element in `_next`.

    An input belongs to a focus when its target starts with the focus target up
    to the bracket.  Distinct input targets are cut at those lengths that the trial's
    focus prefixes have, and the cuts met with the distinct prefixes by equality, so
    no pairs of events are formed and a long target costs no more than its lengths in
    use; events then line up inside (key, prefix) with one as-of step.
    """
    keys = list(keys)
    prefix = F.split(F.coalesce(F.col("target"), F.lit("")), r"\[").getItem(0)
    focus = df.where(F.col("type") == "focus").select(*keys, "id", "us", prefix.alias("_pre"))
    inputs = (df.where((F.col("type") == "input") & F.col("target").isNotNull())
              .select(*keys, "id", "us", F.col("target").alias("_target")))
    begun = focus.select(*keys, "_pre").distinct()
    lengths = begun.groupBy(*keys).agg(F.collect_set(F.length("_pre")).alias("_lengths"))
    spelled = (inputs.select(*keys, "_target").distinct().join(lengths, keys)
               .withColumn("_n", F.explode(F.filter("_lengths", lambda n: n <= F.length("_target"))))
               .select(*keys, "_target", F.substring("_target", F.lit(1), F.col("_n")).alias("_pre")))
    wanted = spelled.join(begun, [*keys, "_pre"], "left_semi")
    matched = inputs.join(wanted, [*keys, "_target"]).select(
        *keys, "_pre", "id", "us", F.lit(True).alias("_is_input"))
    rows = focus.select(*keys, "_pre", "id", "us", F.lit(False).alias("_is_input")).unionByName(matched)
    out = ordered_columns(rows, next_time("_next", F.col("_is_input")), keys=[*keys, "_pre"],
                          slice_us=slice_us)
    return out.where(~F.col("_is_input"))


def click_hold(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Gap from each button press to the next release."""
    rows = df.where(F.col("type").isin("mousedown", "mouseup")).select(*keys, "id", "us", "type")
    out = ordered_columns(rows, next_time("_next", F.col("type") == "mouseup"),
                          keys=keys, slice_us=slice_us)
    return _gap_stats(out.where(F.col("type") == "mousedown"), keys, "click_hold")


def navigation_gap(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Gap from leaving a page to the next user event."""
    left = (F.col("type") == "page") & F.col("action").isin("unload", "pagehide")
    rows = df.where(~is_page_load()).select(*keys, "id", "us", F.coalesce(left, F.lit(False)).alias("_left"))
    out = ordered_columns(rows, next_time("_next", F.lit(True)), keys=keys, slice_us=slice_us)
    return _gap_stats(out.where("_left"), keys, "inter_page_gap")


def load_to_first_action(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Gap from each page load to the next user event on the same page."""
    return _gap_stats(load_ends(df, keys, slice_us), keys, "load_to_first_interact")


def load_ends(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Each page load with the time of the next user event on the same page in `_next`."""
    rows = df.select(*keys, "page", "id", "us", is_page_load().alias("_load"))
    out = ordered_columns(rows, next_time("_next", ~F.col("_load")), keys=[*keys, "page"],
                          slice_us=slice_us)
    return out.where("_load")


def first_interaction_latency(df: DataFrame, keys=TRIAL_KEY) -> DataFrame:
    """Per page: from its first page event (or first event) to the first real action."""
    start = F.coalesce(F.min(F.when(F.col("type") == "page", F.col("us"))), F.min("us"))
    act = F.min(F.when(~F.col("type").isin("page", "visibility"), F.col("us")))
    return df.groupBy(*keys, "page").agg(((act - start) / MS).alias("first_interact_ms"))


def mouse_path_length(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Sum of straight steps between consecutive pointer positions."""
    moves = (df.where((F.col("type") == "mousemove") & F.col("x").isNotNull() & F.col("y").isNotNull())
             .select(*keys, "id", "us", "x", "y"))
    out = ordered_columns(moves, previous("_p", F.struct("x", "y")), keys=keys, slice_us=slice_us)
    dx, dy = F.col("x") - F.col("_p.x"), F.col("y") - F.col("_p.y")
    return out.groupBy(*keys).agg(
        F.coalesce(F.sum(F.sqrt(dx * dx + dy * dy)), F.lit(0.0)).alias("mouse_path_px"))


def priority_depth_growth(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Whether the HTTP/2 priority depth never falls inside a trial, with its range."""
    rows = df.where(F.col("ak_stream_count").isNotNull()).select(*keys, "id", "us", "ak_stream_count")
    out = ordered_columns(rows, previous("_prev", F.col("ak_stream_count")), keys=keys, slice_us=slice_us)
    return out.groupBy(*keys).agg(
        F.countDistinct("ak_stream_count").alias("n_unique"),
        F.bool_and(F.coalesce(F.col("ak_stream_count") >= F.col("_prev"), F.lit(True))).alias("stable"),
        F.min("ak_stream_count").alias("min_depth"), F.max("ak_stream_count").alias("max_depth"))


def trial_ordinal(trials: DataFrame, prefix_length: int = 9) -> DataFrame:
    """One-based number of a trial inside its agent, in name order.

    Names are ranked inside groups that share a leading part, and the group
    sizes are carried, so one agent may own any share of the trials.
    """
    return ordered_columns(trials, running_count("idx"), keys=["agent"], time="trial",
                           tie="trial", slice_by=F.substring("trial", 1, prefix_length))


def reassemble_sessions(df: DataFrame) -> DataFrame:
    """Events of a session in sending order, with their position in the session.

    One row per event, not one array per session: a session of any length stays
    spread over its flushes.
    """
    out = ordered_columns(df.withColumn("_order", F.struct("flush_seq", "us")),
                          running_count("pos"), keys=["session"], time="_order", tie="id",
                          slice_by=F.col("flush_seq"))
    return out.drop("_order")


def merged_event_stream(requests: DataFrame, events: DataFrame, keys=TRIAL_KEY) -> DataFrame:
    """Requests and browser events as one table with a kind column."""
    r = requests.select(*keys, "id", "us", F.lit("request").alias("kind"), "method", "path",
                        F.lit(None).cast("string").alias("type"),
                        F.lit(None).cast("string").alias("page"))
    e = events.select(*keys, "id", "us", F.lit("interaction").alias("kind"),
                      F.lit(None).cast("string").alias("method"),
                      F.lit(None).cast("string").alias("path"), "type", "page")
    return r.unionByName(e)


def time_ordered(stream: DataFrame) -> DataFrame:
    """Global time order (a range-partitioned sort), requests before events on ties."""
    return stream.orderBy("us", F.col("kind").desc(), "id")


BEFORE_ALL = -(2**60)
COUNTERS = {"n_int": "n_int_events", "n_req": "n_requests", "n_page": "page_index"}


def checkpoint_counts(rows: DataFrame, state: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """``rows`` (keys, id, us, event, page, path) with n_int_events, n_requests, page_index,
    page_path and base, the events up to the last page, all counted on from ``state``
    (keys, n_int, n_req, n_page, base, last_path, last_us), the counters of earlier rows.

    The state of a trial enters as a row before all others, marked ``seed``, so sums run
    on from it; a trial is windowed slice by slice, and only one row a slice and trial
    meets the trial's state.  Requests come before events of the same microsecond.
    """
    keys = list(keys)
    no = F.lit(0).cast("long")
    fresh = rows.select(*keys, "id", "us", "event", "page", "path", F.lit(False).alias("seed"), F.col("event").cast("long").alias("n_int"),
                        (~F.col("event")).cast("long").alias("n_req"), F.col("page").cast("long").alias("n_page"), no.alias("base"),
                        F.col("us").alias("last_us"))
    seeds = state.select(*keys, F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit(BEFORE_ALL).alias("us"), F.lit(False).alias("event"),
                         F.lit(False).alias("page"), F.col("last_path").alias("path"), F.lit(True).alias("seed"), *COUNTERS, "base", "last_us")
    every_row = fresh.unionByName(seeds).withColumn("_tie", F.struct(F.col("event").alias("k"), "id"))
    start = F.col("page") | F.col("seed")
    counted = ordered_columns(every_row, *[running_sum(out, F.col(c)) for c, out in COUNTERS.items()],
                              previous("page_path", F.col("path"), start, include_self=True), keys=keys, tie="_tie", slice_us=slice_us)
    reached = F.when(F.col("seed"), F.col("base")).otherwise(F.col("n_int_events"))
    based = ordered_columns(counted.withColumn("_reached", reached), previous("_from", F.col("_reached"), start, include_self=True),
                            keys=keys, tie="_tie", slice_us=slice_us)
    return based.select(*keys, "id", "us", "event", "page", "seed", "last_us", *COUNTERS.values(), F.coalesce("page_path", F.lit("")).alias("page_path"),
                        F.coalesce("_from", F.lit(0)).alias("base"))


def checkpoint_state(counted: DataFrame, keys=TRIAL_KEY) -> DataFrame:
    """The counters of every trial after the rows of ``checkpoint_counts``."""
    order = F.struct("us", "event", "id")
    return counted.groupBy(*keys).agg(*[F.max(out).alias(c) for c, out in COUNTERS.items()], F.max("base").alias("base"),
                                      F.max_by("page_path", order).alias("last_path"), F.max("last_us").alias("last_us"))


def checkpoint_hits(counted: DataFrame, every: int, keys=TRIAL_KEY) -> DataFrame:
    """The rows of ``checkpoint_counts`` that are checkpoints."""
    since = F.col("n_int_events") - F.col("base")
    fires = F.col("event") & (since > 0) & (since % every == 0)
    return counted.where(~F.col("seed") & (F.col("page") | fires)).select(
        *keys, "id", "us", F.when(F.col("page"), "page").otherwise("event").alias("checkpoint"),
        F.when(F.col("page"), F.col("page_index")).alias("page_index"), F.when(~F.col("page"), F.col("n_int_events")).alias("event_index"),
        "page_path", "n_requests", "n_int_events")


def checkpoints(stream: DataFrame, every: int = 50, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Page checkpoints at each page request and event checkpoints every `every`
    interactions since the last checkpoint; a page request starts the count anew."""
    page = ((F.col("kind") == "request") & (F.col("method") == "GET") & is_page())
    page = F.coalesce(page, F.lit(False))
    event = F.col("kind") == "interaction"
    # requests come before events of the same microsecond
    rows = stream.withColumn("_tie", F.struct((F.col("kind") == "interaction").alias("k"), "id"))
    counted = ordered_columns(
        rows, running_count("n_int_events", event),
        running_count("n_requests", F.col("kind") == "request"),
        running_count("page_index", page), first_time("_start"),
        previous("page_path", F.col("path"), page, include_self=True),
        keys=keys, tie="_tie", slice_us=slice_us)
    based = ordered_columns(
        counted, previous("_base", F.col("n_int_events"), page, include_self=True),
        keys=keys, tie="_tie", slice_us=slice_us)
    since = F.col("n_int_events") - F.coalesce(F.col("_base"), F.lit(0))
    fires = event & (since > 0) & (since % every == 0)
    return (based.where(page | fires)
            .select(*keys, "id", "us", F.when(page, "page").otherwise("event").alias("checkpoint"),
                    F.when(page, F.col("page_index")).alias("page_index"),
                    F.when(~page, F.col("n_int_events")).alias("event_index"),
                    F.coalesce("page_path", F.lit("")).alias("page_path"),
                    "n_requests", "n_int_events",
                    ((F.col("us") - F.col("_start")) / SECOND).alias("elapsed_s")))


def request_prefixes(df: DataFrame, max_requests: int = 30, keys=TRIAL_KEY) -> DataFrame:
    """The first n requests of a trial for n = 1 .. min(total, max), keyed by n_req.

    The row limit is applied before the shuffle (a window group limit), so a
    trial of any length sends at most `max_requests` rows per input task.
    """
    w = Window.partitionBy(*keys).orderBy("us", "id")
    head = (df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_requests)
            .withColumn("_top", F.max("_rn").over(Window.partitionBy(*keys))))
    return head.withColumn("n_req", F.explode(F.sequence("_rn", "_top"))).drop("_rn", "_top")


def prefix_cutoffs(prefixes: DataFrame, keys=TRIAL_KEY) -> DataFrame:
    """Time of the last request of each prefix."""
    return prefixes.groupBy(*keys, "n_req").agg(F.max("us").alias("cutoff_us"))


def events_at_cutoff(prefixes: DataFrame, events: DataFrame, keys=TRIAL_KEY) -> DataFrame:
    """For each request prefix, the events no later than its last request.

    Cutoffs of a trial travel as one short array (at most one entry per prefix),
    so the join is one row per trial and an event finds its first prefix by
    counting the cutoffs before it.
    """
    keys = list(keys)
    cuts = (prefix_cutoffs(prefixes, keys).groupBy(*keys)
            .agg(F.array_sort(F.collect_list("cutoff_us")).alias("_cuts")))
    first = F.size(F.filter("_cuts", lambda c: c < F.col("us"))) + 1
    return (events.join(cuts, keys).where(F.col("us") <= F.element_at("_cuts", -1))
            .withColumn("n_req", F.explode(F.sequence(first, F.size("_cuts"))))
            .drop("_cuts"))
