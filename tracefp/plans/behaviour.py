"""Browser-event statistics, behavioural features and client comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefp.functions.events import is_page_load
from tracefp.operators.ordered import next_time, ordered_columns, previous
from tracefp.operators.quantiles import grouped_quantiles
from tracefp.operators.sequences import (click_hold, first_interaction_latency, focus_to_input,
                                         load_to_first_action, mouse_path_length)
from tracefp.schema import EVENT_TYPES, PAGES_WITHOUT_FORMS, SCENARIO_PAGES, TRIAL_KEY
from tracefp.session import materialize

COUNTED = {"n_clicks": "click", "n_keydowns": "keydown", "n_mousemoves": "mousemove",
           "n_scrolls": "scroll", "n_app_events": "app_event"}


def count_type(name: str) -> Column:
    return F.count_if(F.col("type") == name)


def _rate(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, n / seconds).otherwise(0.0)


def _gaps(df: DataFrame, keys, slice_us=None) -> DataFrame:
    """Events with gap_us since the previous event of the trial, null for the first."""
    out = ordered_columns(df, previous("_prev", F.col("us")), keys=keys, slice_us=slice_us)
    return out.withColumn("gap_us", F.col("us") - F.col("_prev")).drop("_prev")


def interaction_session_stats(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Counts, duration, rate and interval statistics per trial."""
    keys = list(keys)
    rows = _gaps(df.select(*keys, "id", "us", "page", "flush_seq", "type"), keys, slice_us)
    # written once: moments and exact medians both read it
    rows = materialize(rows, "session-events")
    seconds = (F.max("us") - F.min("us")) / 1e6
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"), F.countDistinct("page").alias("n_pages"),
        seconds.alias("duration_s"), _rate(F.count(F.lit(1)), seconds).alias("event_rate_hz"),
        F.countDistinct("flush_seq").alias("n_flushes"),
        *[count_type(t).alias(n) for n, t in COUNTED.items()],
        (F.avg("gap_us") / 1e3).alias("iei_mean_ms"),
        (F.stddev_samp("gap_us") / 1e3).alias("iei_std_ms"))
    medians = grouped_quantiles(rows, keys, "gap_us", {"_m": 0.5})
    return (stats.join(medians, keys, "left")
            .withColumn("iei_median_ms", F.col("_m") / 1e3).drop("_m"))


def interaction_page_stats(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Per page of a trial: density, latency, counts, pointer path, hold and reaction
    times, scroll depth and mean interval (trial intervals, a page's first left out)."""
    keys = list(keys)
    pk = [*keys, "page"]
    cols = df.select(*pk, "id", "us", "type", "target", "x", "y", "scroll_y")
    # the log is read once; every part below reads these narrow rows
    rows = materialize(_gaps(cols, keys, slice_us), "page-events")
    cols = rows.drop("gap_us")
    # the interval of a page's first event is dropped, whatever its value
    first = F.min(F.struct("us", "id", F.coalesce("gap_us", F.lit(0)).alias("g")))
    seconds = (F.max("us") - F.min("us")) / 1e6
    n = F.count(F.lit(1))
    stats = rows.groupBy(*pk).agg(
        n.alias("n_events"), seconds.alias("duration_s"), _rate(n, seconds).alias("event_density"),
        *[count_type(t).alias(c) for c, t in COUNTED.items()],
        F.coalesce(F.max("scroll_y"), F.lit(0.0)).alias("scroll_depth_px"),
        F.sum(F.coalesce("gap_us", F.lit(0))).alias("_sum"), first.alias("_first"))
    stats = stats.withColumn(
        "iei_mean_ms", F.when(F.col("n_events") > 1, (F.col("_sum") - F.col("_first.g"))
                              / (F.col("n_events") - 1) / 1e3)).drop("_sum", "_first")
    parts = [
        first_interaction_latency(cols, keys),
        mouse_path_length(cols, pk, slice_us).withColumnRenamed("mouse_path_px", "mouse_traj_px"),
        click_hold(cols, pk, slice_us).select(*pk, "click_hold_mean_ms"),
        focus_to_input(cols, pk, slice_us).select(
            *pk, F.col("focus_to_input_mean_ms").alias("focus_react_mean_ms")),
    ]
    out = reduce(lambda a, b: a.join(b, pk, "left"), parts, stats)
    return out.withColumn("mouse_traj_px", F.coalesce("mouse_traj_px", F.lit(0.0)))


def event_type_profile(df: DataFrame, types=tuple(EVENT_TYPES), keys=TRIAL_KEY) -> DataFrame:
    """Share of each event type per page of a trial, zero-filled.

    Types outside the list still count in the total.
    """
    n = F.count(F.lit(1))
    return df.groupBy(*keys, "page").agg(*[(count_type(t) / n).alias(f"p_{t}") for t in types])


PAGE_METRICS = ["n_events", "duration_s", "event_density", "first_interact_ms", *COUNTED,
                "mouse_traj_px", "click_hold_mean_ms", "focus_react_mean_ms", "scroll_depth_px",
                "iei_mean_ms"]


def page_stats_rollup(pages: DataFrame, keys=("page",)) -> DataFrame:
    """Mean and standard deviation over trials of every page metric."""
    aggs = []
    for m in PAGE_METRICS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return pages.groupBy(*keys).agg(*aggs)


def event_profile_rollup(df: DataFrame, keys=TRIAL_KEY, group=("page",)) -> DataFrame:
    """Mean share over trials per page and type, in long form.

    A type absent from a whole trial is left out of the mean there; a type that
    the trial shows on another page counts as zero.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, "page", "type").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys, "page").agg(F.sum("n").alias("total"))
    types = counts.select(*keys, "type").distinct()
    grid = totals.join(types, keys)
    share = (grid.join(counts, [*keys, "page", "type"], "left")
             .withColumn("share", F.coalesce("n", F.lit(0)) / F.col("total")))
    return share.groupBy(*group, "type").agg(F.avg("share").alias("mean_share"),
                                             F.count(F.lit(1)).alias("n_trials"))


# ---- behavioural features -------------------------------------------------
#
# Each group is a list of aggregates; one grouped pass over the timeline
# evaluates all of them together, and the functions below evaluate one group.


def _some(condition: Column) -> Column:
    return (F.count_if(condition) > 0).cast("int")


def _is_left() -> Column:
    left = (F.col("type") == "page") & F.col("action").isin("unload", "pagehide")
    return F.coalesce(left, F.lit(False))


def _is_pointer() -> Column:
    return (F.col("type") == "mousemove") & F.col("x").isNotNull() & F.col("y").isNotNull()


def behaviour_timeline(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Events with every look-back and look-ahead time the features need, in one slice pass."""
    out = ordered_columns(
        df, previous("_prev", F.col("us")), previous("_user", F.lit(1), ~is_page_load()),
        next_time("_up", F.col("type") == "mouseup"), next_time("_next_user", ~is_page_load()),
        previous("_at", F.struct("x", "y"), _is_pointer()), keys=keys, slice_us=slice_us)
    dx, dy = F.col("x") - F.col("_at.x"), F.col("y") - F.col("_at.y")
    gap = F.col("us") - F.col("_prev")
    # the interval runs from any earlier event, but the first user event has none
    counted = ~is_page_load() & F.col("_user").isNotNull() & (gap > 0)
    return (out.withColumn("iei_us", F.when(counted, gap))
            .withColumn("hold_us", F.when(F.col("type") == "mousedown", F.col("_up") - F.col("us")))
            .withColumn("leave_us", F.when(_is_left(), F.col("_next_user") - F.col("us")))
            .withColumn("step_px", F.when(_is_pointer(), F.sqrt(dx * dx + dy * dy)))
            .drop("_prev", "_user", "_up", "_next_user", "_at"))


def _count_group() -> list[Column]:
    user_us = F.when(~is_page_load(), F.col("us"))
    seconds = F.greatest((F.max(user_us) - F.min(user_us)) / 1e6, F.lit(1e-6))
    n = F.count_if(~is_page_load())
    return [n.alias("n_events"), seconds.alias("duration_s"), (n / seconds).alias("event_rate_hz"),
            F.countDistinct("page").alias("n_pages"),
            *[count_type(t).alias(c) for c, t in COUNTED.items()],
            count_type("input").alias("n_inputs"), count_type("focus").alias("n_focus"),
            F.count_if((F.col("type") == "visibility") & (F.col("state") == "hidden")).alias("n_tab_switches"),
            F.count(F.lit(1)).alias("n_total")]


def behaviour_counts(df: DataFrame, keys=TRIAL_KEY) -> DataFrame:
    """Events without page loads, duration, rate, pages and type counts."""
    return df.groupBy(*keys).agg(*_count_group()).where(F.col("n_events") > 0)


def _interval_group() -> list[Column]:
    return [(F.avg("iei_us") / 1e3).alias("iei_mean_ms"), (F.stddev_samp("iei_us") / 1e3).alias("iei_std_ms"),
            F.avg((F.col("iei_us") < 50_000).cast("int")).alias("iei_burst_ratio")]


def _interval_quantiles(timeline: DataFrame, keys) -> DataFrame:
    q = grouped_quantiles(timeline, keys, "iei_us", {"_m": 0.5, "_p": 0.95})
    return q.select(*keys, (F.col("_m") / 1e3).alias("iei_median_ms"), (F.col("_p") / 1e3).alias("iei_p95_ms"))


def behaviour_intervals(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Positive intervals of user events (a trial's first user event left out)."""
    keys = list(keys)
    rows = ordered_columns(
        df.select(*keys, "id", "us", "type", "action"), previous("_prev", F.col("us")),
        previous("_user", F.lit(1), ~is_page_load()), keys=keys, slice_us=slice_us)
    gap = F.col("us") - F.col("_prev")
    gaps = rows.where(~is_page_load() & F.col("_user").isNotNull() & (gap > 0)).select(*keys, gap.alias("iei_us"))
    return gaps.groupBy(*keys).agg(*_interval_group()).join(_interval_quantiles(gaps, keys), keys, "left")


SHARES = {"mousemove_ratio": "n_mousemoves", "keydown_ratio": "n_keydowns", "scroll_ratio": "n_scrolls",
          "input_ratio": "n_inputs", "click_ratio": "n_clicks", "app_event_ratio": "n_app_events"}


def _ratio_columns() -> list[Column]:
    kd, mm = F.col("n_keydowns"), F.col("n_mousemoves")
    return [*[(F.col(c) / F.col("n_total")).alias(n) for n, c in SHARES.items()],
            ((kd - mm) / F.greatest(kd + mm, F.lit(1))).alias("kbd_vs_mouse")]


def behaviour_ratios(counts: DataFrame, keys=TRIAL_KEY) -> DataFrame:
    """Type shares and the keyboard-against-mouse index, from the counts."""
    return counts.select(*keys, *_ratio_columns())


def page_prefix(page: str) -> str:
    return page.replace("-", "_")


def _page_group(pages, no_forms) -> list[Column]:
    aggs = []
    for page in pages:
        here = F.col("page") == page
        n = F.count_if(here)
        for t in ("mousemove", "keydown", "input", "scroll", "click"):
            share = F.when(n > 0, F.count_if(here & (F.col("type") == t)) / n).otherwise(0.0)
            aggs.append(share.alias(f"{page_prefix(page)}__{t}_prop"))
        aggs.append((n > 0).cast("int").alias(f"{page_prefix(page)}__visited"))
    plain = F.col("page").isin(*no_forms)
    presses = F.count_if(plain & (F.col("type") == "keydown"))
    return [*aggs, presses.alias("nonform_keydown_count"),
            F.when(F.count_if(plain) > 0, presses / F.count_if(plain)).otherwise(0.0).alias("nonform_keydown_ratio")]


def behaviour_page_props(df: DataFrame, pages=tuple(SCENARIO_PAGES),
                         no_forms=tuple(PAGES_WITHOUT_FORMS), keys=TRIAL_KEY) -> DataFrame:
    """Type shares and visited flag per scenario page, and key presses on pages without forms."""
    return df.groupBy(*keys).agg(*_page_group(pages, no_forms))


def _mouse_group() -> list[Column]:
    at = (F.col("type") == "click") & F.col("x").isNotNull() & F.col("y").isNotNull()
    x, y = F.when(at, F.col("x")), F.when(at, F.col("y"))

    def spread(c: Column) -> Column:
        return F.when(F.count(c) > 1, F.stddev_samp(c)).when(F.count(c) == 1, 0.0)

    total = F.coalesce(F.sum("step_px"), F.lit(0.0))
    return [total.alias("mouse_traj_total_px"),
            (total / F.greatest(F.countDistinct("page"), F.lit(1))).alias("mouse_traj_mean_px_per_page"),
            F.avg(x).alias("click_x_mean"), F.avg(y).alias("click_y_mean"),
            spread(x).alias("click_x_std"), spread(y).alias("click_y_std"),
            F.countDistinct(F.when(F.col("type") == "click", F.col("target"))).alias("n_unique_click_targets")]


def behaviour_mouse(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Pointer path, click position statistics and distinct click targets."""
    keys = list(keys)
    rows = ordered_columns(df.select(*keys, "id", "us", "type", "page", "target", "x", "y"),
                           previous("_at", F.struct("x", "y"), _is_pointer()), keys=keys, slice_us=slice_us)
    dx, dy = F.col("x") - F.col("_at.x"), F.col("y") - F.col("_at.y")
    return (rows.withColumn("step_px", F.when(_is_pointer(), F.sqrt(dx * dx + dy * dy)))
            .groupBy(*keys).agg(*_mouse_group()))


def _modifiers(df: DataFrame) -> Column:
    """Number of modifier keys held; absent modifier columns count as not held."""
    held = [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("ctrl", "shift", "alt", "meta")
            if c in df.columns]
    return reduce(lambda a, b: a + b, held, F.lit(0))


KEYBOARD = ["enter_key_count", "enter_key_ratio", "n_unique_keys", "modifier_key_count",
            "modifier_key_ratio", "key_entropy"]


def _key_table(df: DataFrame, keys) -> DataFrame:
    """Keyboard features of trials that press keys; counts per key come first."""
    down = df.where(F.col("type") == "keydown").select(
        *keys, F.trim(F.coalesce("key", F.lit(""))).alias("_key"), _modifiers(df).alias("_mods"))
    per_key = down.groupBy(*keys, "_key").agg(F.count(F.lit(1)).alias("n"), F.sum("_mods").alias("mods"))
    totals = per_key.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum("mods").alias("modifier_key_count"),
        F.count(F.lit(1)).alias("n_unique_keys"),
        F.sum(F.when(F.col("_key") == "Enter", F.col("n")).otherwise(0)).alias("enter_key_count"))
    p = F.col("n") / F.col("total")
    entropy = (per_key.join(totals.select(*keys, "total"), keys)
               .groupBy(*keys).agg((-F.sum(p * F.log2(p + 1e-12))).alias("key_entropy")))
    return (totals.join(entropy, keys)
            .withColumn("enter_key_ratio", F.col("enter_key_count") / F.col("total"))
            .withColumn("modifier_key_ratio", F.col("modifier_key_count") / F.col("total")).drop("total"))


def _keyboard_columns() -> list[Column]:
    return [F.coalesce(n, F.lit(0)).cast("double" if n.endswith(("ratio", "entropy")) else "bigint").alias(n)
            for n in KEYBOARD]


def behaviour_keyboard(df: DataFrame, keys=TRIAL_KEY) -> DataFrame:
    """Enter and modifier use, distinct keys and key entropy; zeros without key presses."""
    keys = list(keys)
    return (df.select(*keys).distinct().join(_key_table(df, keys), keys, "left")
            .select(*keys, *_keyboard_columns()))


def _scroll_group() -> list[Column]:
    y = F.when(F.col("type") == "scroll", F.col("scroll_y"))
    return [F.coalesce(F.max(y), F.lit(0.0)).alias("max_scroll_depth_px"),
            F.coalesce(F.avg(y), F.lit(0.0)).alias("scroll_depth_mean_px")]


def behaviour_scroll(df: DataFrame, keys=TRIAL_KEY) -> DataFrame:
    return df.groupBy(*keys).agg(*_scroll_group())


def behaviour_pages(df: DataFrame, pages=tuple(SCENARIO_PAGES), keys=TRIAL_KEY) -> DataFrame:
    """Distinct pages, visited bitmask and dwell statistics over pages with two user events."""
    user_us = F.when(~is_page_load(), F.col("us"))
    bit = F.lit(0)
    for i, page in enumerate(pages):
        bit = F.when(F.col("page") == page, F.lit(1 << i)).otherwise(bit)
    per_page = df.groupBy(*keys, "page").agg(
        F.when(F.count(user_us) > 1, (F.max(user_us) - F.min(user_us)) / 1e6).alias("dwell_s"),
        F.max(bit).alias("bit"))
    return per_page.groupBy(*keys).agg(
        F.count("page").alias("n_unique_pages"), F.sum("bit").cast("bigint").alias("pages_visited_bitmask"),
        F.avg("dwell_s").alias("page_dwell_mean_s"), F.stddev_samp("dwell_s").alias("page_dwell_std_s"),
        F.min("dwell_s").alias("page_dwell_min_s"), F.max("dwell_s").alias("page_dwell_max_s"))


def _task_group() -> list[Column]:
    app = F.col("type") == "app_event"
    detail, name = F.coalesce("detail", F.lit("")), F.coalesce("log_event", F.lit(""))
    chosen = app & (name == "select")
    return [
        F.count_if(app & detail.rlike("Subscribed|checkmark")).alias("n_successful_submits"),
        F.count_if(app & detail.contains("BLOCKED")).alias("n_blocked_submits"),
        _some(app & detail.rlike("CORRECT|Hidden button")).alias("hover_reveal_correct"),
        _some(chosen & detail.rlike("CORRECT|mars")).alias("dom_mismatch_correct"),
        _some(chosen & detail.contains("INCORRECT")).alias("dom_mismatch_wrong"),
        F.count_if(app & detail.rlike("NO EFFECT|False cue")).alias("false_cue_clicks"),
        F.count_if(app & F.lower(name).contains("hover")).alias("n_hover_events"),
        F.count_if(chosen).alias("n_select_events"),
        _some(app & detail.rlike("retry|Retry")).alias("delayed_feedback_retry"),
        _some(app & detail.rlike("completed|Completed|Done")).alias("delayed_feedback_completed"),
        F.count_if((F.col("type") == "click") & F.coalesce("target", F.lit("")).contains("nav-tab"))
        .alias("nav_via_tab_clicks")]


def task_outcomes(df: DataFrame, keys=TRIAL_KEY) -> DataFrame:
    """Outcome counts and flags by pattern over application-event detail."""
    return df.groupBy(*keys).agg(*_task_group())


def _gap_group(column: str, name: str) -> list[Column]:
    return [(F.avg(column) / 1e3).alias(f"{name}_mean_ms"), (F.stddev_samp(column) / 1e3).alias(f"{name}_std_ms")]


def behaviour_trial_features(df: DataFrame, keys=TRIAL_KEY, slice_us=None,
                             pages=tuple(SCENARIO_PAGES),
                             no_forms=tuple(PAGES_WITHOUT_FORMS)) -> DataFrame:
    """Every behavioural feature of a trial in one row; trials of page loads only are absent."""
    keys = list(keys)
    # the log is read once: every part below reads the timeline
    line = materialize(behaviour_timeline(df, keys, slice_us), "behaviour")
    df = line.select(*df.columns)
    out = (line.groupBy(*keys).agg(
        *_count_group(), *_interval_group(), *_page_group(pages, no_forms), *_mouse_group(),
        *_scroll_group(), *_task_group(), *_gap_group("hold_us", "click_hold"),
        *_gap_group("leave_us", "inter_page_gap"))
        .where(F.col("n_events") > 0))
    out = (out.select("*", *_ratio_columns()).drop("n_total")
           .withColumn("iei_burst_ratio", F.coalesce("iei_burst_ratio", F.lit(0.0))))
    focus = focus_to_input(df, keys, slice_us)
    load = load_to_first_action(df, keys, slice_us)
    parts = [_interval_quantiles(line, keys), behaviour_pages(df, pages, keys), _key_table(df, keys),
             focus.select(*keys, *[F.col(f"focus_to_input_{s}_ms").alias(f"focus_to_input_latency_{s}_ms")
                                   for s in ("mean", "std")]),
             load.select(*keys, "load_to_first_interact_mean_ms", "load_to_first_interact_std_ms")]
    out = reduce(lambda a, b: a.join(b, keys, "left"), parts, out)
    return out.select(*[c for c in out.columns if c not in KEYBOARD], *_keyboard_columns())


# ---- client comparisons ---------------------------------------------------


def scenario_comparison(pages: DataFrame, scenarios=tuple(SCENARIO_PAGES)) -> DataFrame:
    """Client by scenario page: mean and std of density, latency and pointer path.

    Pages a client never shows stay as null rows; the grid is the client list
    times a fixed list, built by an explode.
    """
    metrics = {"event_density": "event_density", "first_interact_ms": "first_interact_ms",
               "mouse_traj_px": "mouse_traj_px"}
    aggs = []
    for m, out in metrics.items():
        aggs += [F.avg(m).alias(f"{out}_mean"), F.stddev_samp(m).alias(f"{out}_std")]
    stats = pages.groupBy("agent", "page").agg(*aggs)
    order = F.array(*[F.struct(F.lit(i).alias("scenario"), F.lit(p).alias("page"))
                      for i, p in enumerate(scenarios, 1)])
    grid = pages.select("agent").distinct().select("agent", F.inline(order))
    return grid.join(stats, ["agent", "page"], "left")


def keyboard_mouse_centroid(stats: DataFrame) -> DataFrame:
    return stats.groupBy("agent").agg(F.avg("n_keydowns").alias("keydown_center"),
                                      F.avg("n_mousemoves").alias("mousemove_center"))


DROPPED_EVENTS = ["app_event", "page", "keyup", "mouseup", "mousedown", "focus", "blur", "change",
                  "selection", "visibility"]


def noticeable_events_pages(df: DataFrame, event_threshold: float, page_threshold: float,
                            dropped=tuple(DROPPED_EVENTS)) -> DataFrame:
    """(agent, page, type, share) kept where clients differ enough.

    A type is kept when its client means vary by the threshold (sample
    variance); a page when every client shows it and its values over kept types
    vary by the threshold (population variance).  Missing shares are zero.
    """
    profile = materialize(event_profile_rollup(df, group=("agent", "page")), "profile")
    cells = profile.where(~F.col("type").isin(*dropped)).select("agent", "page", "type", "mean_share")
    shown = profile.select("agent", "page").distinct()
    pages_of = shown.groupBy("agent").agg(F.count(F.lit(1)).alias("n_pages"))
    per_agent = (cells.groupBy("agent", "type").agg(F.sum("mean_share").alias("s"))
                 .join(pages_of, ["agent"]).withColumn("m", F.col("s") / F.col("n_pages")))
    # variance with the agents that never show a type counted as zero
    n_agents = shown.agg(F.countDistinct("agent").cast("double").alias("n"))
    moments = (per_agent.groupBy("type").agg(F.sum("m").alias("s1"),
                                             F.sum(F.col("m") * F.col("m")).alias("s2"))
               .withColumn("n", n_agents.scalar()))
    var = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / (F.col("n") - 1)
    events = moments.where(var >= event_threshold).select("type")
    full = (shown.groupBy("page").agg(F.count(F.lit(1)).alias("c"))
            .where(F.col("c") == n_agents.scalar()).select("page"))
    kept = cells.join(events, ["type"]).join(full, ["page"])
    size = F.col("n_a") * F.col("n_e")
    n_events = events.agg(F.count(F.lit(1)).cast("double").alias("n"))
    by_page = (kept.groupBy("page").agg(F.sum("mean_share").alias("s1"),
                                        F.sum(F.col("mean_share") * F.col("mean_share")).alias("s2"))
               .withColumn("n_a", n_agents.scalar()).withColumn("n_e", n_events.scalar()))
    spread = F.col("s2") / size - (F.col("s1") / size) * (F.col("s1") / size)
    pages = by_page.where(spread >= page_threshold).select("page")
    # event types are a short, closed list, so they travel as one array
    types = events.agg(F.array_sort(F.collect_set("type")).alias("t"))
    wide = shown.join(pages, ["page"]).withColumn("type", F.explode(types.scalar()))
    return (wide.join(cells, ["agent", "page", "type"], "left")
            .select("agent", "page", "type", F.coalesce("mean_share", F.lit(0.0)).alias("share")))


def mouse_grid(df: DataFrame, bins: int = 30, width: float = 1440, height: float = 900,
               keys=TRIAL_KEY) -> DataFrame:
    """Counts of pointer positions per cell; positions outside the viewport are left out."""
    moves = df.where((F.col("type") == "mousemove") & F.col("x").between(0, width)
                     & F.col("y").between(0, height))

    def cell(c: str, size: float) -> Column:
        return F.least(F.floor(F.col(c) * bins / F.lit(float(size))), F.lit(bins - 1)).cast("int")

    return (moves.select(*keys, cell("x", width).alias("bx"), cell("y", height).alias("by"))
            .groupBy(*keys, "bx", "by").agg(F.count(F.lit(1)).alias("n")))
