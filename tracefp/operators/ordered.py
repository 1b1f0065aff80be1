"""Ordered computations over a key whose rows may not fit one task.

A plain window partitioned by trial puts a whole trial into one task.  Here a
trial is cut into time slices; each slice is windowed on its own, one summary
row per slice is aggregated (with map-side combine), the summaries are carried
over the slices of the trial, and the carry is joined back on (key, slice).
Only summaries ever meet in one task, so a trial that holds a third of all
rows is spread over as many tasks as it has slices.  Results do not depend on
the slice length.

Slices are equally long, or, where the session names a row target
(``tracefp.slice.rows``), cut where the counted rows of a trial say, so a busy hour is
many slices and idle weeks are one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefp.schema import TRIAL_KEY
from tracefp.session import materialize

HOUR_US = 3_600_000_000
MINUTE_US, MS_US = 60_000_000, 1_000
SLICE_CONF = "tracefp.slice.us"
ROWS_CONF = "tracefp.slice.rows"
_SLICE = "_slice"


def slice_length(df: DataFrame, slice_us: int | None = None) -> int:
    """Slice length in microseconds: argument, then session setting, then 1 h."""
    if slice_us:
        return int(slice_us)
    return int(df.sparkSession.conf.get(SLICE_CONF, str(HOUR_US)))


def time_slice(time: str, slice_us: int) -> Column:
    return F.floor(F.col(time) / F.lit(slice_us)).cast("long")


def _cumulative(cells: DataFrame, keys: Sequence[str], cell: str) -> DataFrame:
    """Rows of earlier cells of the same keys as ``_before``."""
    w = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("_before", F.coalesce(F.sum("_rows").over(w), F.lit(0)))


def slice_starts(df: DataFrame, target: int, keys: Sequence[str] = TRIAL_KEY, time: str = "us") -> DataFrame:
    """(keys, _minute, _first, _cuts): the number of the slice in which each minute of a
    key that has rows begins, and the times inside it at which new slices begin.

    Rows are counted per minute, and per millisecond in minutes of more than ``target``
    rows; a key's counts, not its rows, are summed up in order.  A slice holds fewer than
    twice ``target`` rows and those of one millisecond.
    """
    keys, target = list(keys), int(target)
    if target < 1:
        raise ValueError("a slice holds at least one row")
    minute = F.floor(F.col(time) / MINUTE_US).cast("long").alias("_minute")
    minutes = df.groupBy(*keys, minute).agg(F.count(F.lit(1)).alias("_rows"))
    busy = minutes.where(F.col("_rows") > target).select(*[F.col(k).alias(f"_busy_{k}") for k in keys], F.col("_minute").alias("_busy_minute"))
    same = F.col("_minute") == F.col("_busy_minute")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_busy_{k}"))
    ms = df.select(*keys, minute, F.floor(F.col(time) / MS_US).cast("long").alias("_ms")).groupBy(*keys, "_minute", "_ms").agg(
        F.count(F.lit(1)).alias("_rows")).join(busy, same, "left_semi")
    inner = _cumulative(ms, [*keys, "_minute"], "_ms")
    # a cut where the sum reaches another multiple of the target
    turn = F.floor(F.col("_before") / target)
    w = Window.partitionBy(*keys, "_minute").orderBy("_ms")
    cuts = inner.withColumn("_turn", turn).withColumn("_new", F.col("_turn") > F.lag("_turn", 1).over(w)).where("_new").groupBy(*keys, "_minute").agg(
        F.array_sort(F.collect_list(F.col("_ms") * MS_US)).alias("_cuts"))
    other = cuts.withColumnsRenamed({c: f"_cut_{c}" for c in (*keys, "_minute")})
    same = F.col("_minute").eqNullSafe(F.col("_cut__minute"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_cut_{k}"))
    cut = minutes.join(other, same, "left").select(*keys, "_minute", "_rows", F.coalesce("_cuts", F.array().cast("array<bigint>")).alias("_cuts"))
    # a busy minute begins a slice and so does the minute after it; others share slices up to the target
    by = Window.partitionBy(*keys).orderBy("_minute")
    full = F.col("_rows") > target
    edge = (full | F.coalesce(F.lag(full, 1).over(by), F.lit(True))).cast("long")
    running = by.rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("_edge", edge).withColumn("_run", F.sum("_edge").over(running))
    shared = _cumulative(cut, [*keys, "_run"], "_minute").withColumn("_step", F.floor(F.col("_before") / target).cast("long"))
    begins = F.coalesce((F.col("_step") > F.lag("_step", 1).over(Window.partitionBy(*keys, "_run").orderBy("_minute"))).cast("long"), F.lit(1))
    numbered = shared.withColumn("_begins", begins)
    first = F.sum(F.col("_begins")).over(running) + F.coalesce(F.sum(F.size("_cuts")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return numbered.select(*keys, "_minute", first.cast("long").alias("_first"), "_cuts")


def counted_slices(df: DataFrame, target: int, keys: Sequence[str] = TRIAL_KEY, time: str = "us") -> DataFrame:
    """df with ``_slice``, cut by ``slice_starts``; it never decreases in time.

    The starts, at most one row per key and minute with rows, are written once."""
    keys = list(keys)
    starts = materialize(slice_starts(df, target, keys, time), "slices").withColumnsRenamed({c: f"_start_{c}" for c in (*keys, "_minute")})
    same = F.floor(F.col(time) / MINUTE_US).cast("long").eqNullSafe(F.col("_start__minute"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_start_{k}"))
    passed = F.size(F.filter("_cuts", lambda c: c <= F.col(time)))
    return df.join(starts, same).withColumn(_SLICE, F.col("_first") + passed).drop(*[f"_start_{k}" for k in keys], "_start__minute", "_first", "_cuts")


class _Spec:
    """One derived column: its in-slice part, slice summary, carry and merge."""

    def __init__(self, name: str):
        self.name = name
        self.here, self.tot, self.carry = f"_h_{name}", f"_t_{name}", f"_c_{name}"


class previous(_Spec):
    """`value` of the latest earlier row (by time, then tie) where `when` holds.

    With `include_self` the current row counts, which is a forward fill.
    """

    def __init__(self, name, value, when=None, include_self=False):
        super().__init__(name)
        self.value, self.when, self.include_self = value, when, include_self

    def _picked(self, order):
        picked = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                          self.value.alias("v"))
        return picked if self.when is None else F.when(self.when, picked)

    def local(self, keys, order):
        w = (Window.partitionBy(*keys, _SLICE).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, 0 if self.include_self else -1))
        return F.last(self._picked(order), ignorenulls=True).over(w).alias(self.here)

    def summary(self, order):
        return F.max(self._picked(order)).alias(self.tot)

    def carried(self, keys):
        w = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        return F.last(F.col(self.tot), ignorenulls=True).over(w).alias(self.carry)

    def merged(self):
        return F.coalesce(F.col(self.here), F.col(self.carry)).getField("v").alias(self.name)


class next_time(_Spec):
    """Time of the first row strictly later than this one where `when` holds.

    The frame runs backwards in time: a frame open towards the end would be
    evaluated anew for every row, one open towards the start is incremental.
    """

    def __init__(self, name, when):
        super().__init__(name)
        self.when = when

    def local(self, keys, order):
        w = (Window.partitionBy(*keys, _SLICE).orderBy(F.col(order[0]).desc())
             .rangeBetween(Window.unboundedPreceding, -1))
        return F.min(F.when(self.when, F.col(order[0]))).over(w).alias(self.here)

    def summary(self, order):
        return F.min(F.when(self.when, F.col(order[0]))).alias(self.tot)

    def carried(self, keys):
        w = (Window.partitionBy(*keys).orderBy(F.col(_SLICE).desc())
             .rowsBetween(Window.unboundedPreceding, -1))
        return F.last(F.col(self.tot), ignorenulls=True).over(w).alias(self.carry)

    def merged(self):
        return F.coalesce(F.col(self.here), F.col(self.carry)).alias(self.name)


class prior_time(_Spec):
    """Time of the last row strictly earlier than this one where `when` holds."""

    def __init__(self, name, when):
        super().__init__(name)
        self.when = when

    def local(self, keys, order):
        w = (Window.partitionBy(*keys, _SLICE).orderBy(order[0])
             .rangeBetween(Window.unboundedPreceding, -1))
        return F.max(F.when(self.when, F.col(order[0]))).over(w).alias(self.here)

    def summary(self, order):
        return F.max(F.when(self.when, F.col(order[0]))).alias(self.tot)

    def carried(self, keys):
        w = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        return F.last(F.col(self.tot), ignorenulls=True).over(w).alias(self.carry)

    def merged(self):
        return F.coalesce(F.col(self.here), F.col(self.carry)).alias(self.name)


class running_count(_Spec):
    """Number of rows up to and including this one where `when` holds."""

    def __init__(self, name, when=None):
        super().__init__(name)
        self.when = when

    def _one(self):
        return F.lit(1) if self.when is None else F.when(self.when, F.lit(1))

    def local(self, keys, order):
        w = (Window.partitionBy(*keys, _SLICE).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, 0))
        return F.count(self._one()).over(w).alias(self.here)

    def summary(self, order):
        return F.count(self._one()).alias(self.tot)

    def carried(self, keys):
        w = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        return F.sum(F.col(self.tot)).over(w).alias(self.carry)

    def merged(self):
        return (F.col(self.here) + F.coalesce(F.col(self.carry), F.lit(0))).alias(self.name)


class running_sum(running_count):
    """Sum of ``value`` up to and including this row; nulls add nothing."""

    def __init__(self, name, value):
        super().__init__(name)
        self.value = F.coalesce(value, F.lit(0)).cast("long")

    def local(self, keys, order):
        w = (Window.partitionBy(*keys, _SLICE).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, 0))
        return F.sum(self.value).over(w).alias(self.here)

    def summary(self, order):
        return F.sum(self.value).alias(self.tot)


class first_time(_Spec):
    """Earliest time of the whole key, repeated on every row."""

    def local(self, keys, order):
        return F.lit(None).cast("long").alias(self.here)

    def summary(self, order):
        return F.min(F.col(order[0])).alias(self.tot)

    def carried(self, keys):
        return F.min(F.col(self.tot)).over(Window.partitionBy(*keys)).alias(self.carry)

    def merged(self):
        return F.col(self.carry).alias(self.name)


def ordered_columns(df: DataFrame, *specs: _Spec, keys: Sequence[str] = TRIAL_KEY,
                    time: str = "us", tie: str = "id", slice_us: int | None = None,
                    slice_by: Column | None = None) -> DataFrame:
    """Add the columns described by `specs`; every spec shares one slice pass.

    `slice_by` replaces the time slice by any column that never decreases in
    (time, tie) order, for keys not ordered by time.  Without either argument, a session
    that names a row target has its slices cut by counted rows.
    """
    keys, order = list(keys), [time, tie]
    target = df.sparkSession.conf.get(ROWS_CONF, None)
    if slice_by is None and slice_us is None and target:
        base = counted_slices(df, int(target), keys, time)
    else:
        base = df.withColumn(_SLICE, slice_by if slice_by is not None else time_slice(time, slice_length(df, slice_us)))
    inner = base.select("*", *[s.local(keys, order) for s in specs])
    carry = (base.groupBy(*keys, _SLICE).agg(*[s.summary(order) for s in specs])
             .select(*keys, _SLICE, *[s.carried(keys) for s in specs]))
    # null keys and times have slices of their own, which meet as any others
    met, same = {c: f"_carry_{c}" for c in (*keys, _SLICE)}, F.lit(True)
    for c, other in met.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    return (inner.join(carry.withColumnsRenamed(met), same, "left")
            .select("*", *[s.merged() for s in specs])
            .drop(*met.values())
            .drop(_SLICE, *[s.here for s in specs], *[s.carry for s in specs]))


def halo_slices(df: DataFrame, reach_us: int, time: str = "us",
                slice_us: int | None = None) -> tuple[DataFrame, str, str]:
    """Copy each row into every slice its ±reach touches (at most two).

    A frame bounded by `reach_us` can then be evaluated per (key, slice) alone.
    Returns the frame and the names of its slice and home-flag columns.
    """
    size = max(slice_length(df, slice_us), 2 * int(reach_us), 1)
    home = time_slice(time, size)
    low = F.floor((F.col(time) - F.lit(int(reach_us))) / F.lit(size)).cast("long")
    high = F.floor((F.col(time) + F.lit(int(reach_us))) / F.lit(size)).cast("long")
    out = (df.withColumn("_home", home)
           .withColumn(_SLICE, F.explode(F.sequence(low, high))))
    return out.withColumn("_home", F.col("_home") == F.col(_SLICE)), _SLICE, "_home"
