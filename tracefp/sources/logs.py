"""Readers of request logs, interaction logs and trial windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefp.functions.events import page_label_column
from tracefp.functions.requests import event_time
from tracefp.operators.ordered import ordered_columns, running_count
from tracefp.schema import FLUSH_RECORD, REQUEST_RECORD


def _file_path() -> Column:
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def label_from_layout(df: DataFrame, root: str, agents=None, default_agent: str = "") -> DataFrame:
    """Agent and trial from <root>/<agent>/<trial>/<file>.

    <root>/<trial>/<file> and flat files are accepted too; then the agent is
    `default_agent` and a flat file is its own trial.  Folders written as
    agent=<agent> and trial=<trial> name the same.  `agents` keeps a subset.
    """
    tail = F.substring_index(_file_path(), root.rstrip("/") + "/", -1)
    parts = F.split(tail, "/")
    n = F.size(parts)
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")

    def folder(up: int) -> Column:
        return F.regexp_replace(F.get(parts, n - up), "^(agent|trial)=", "")

    out = df.select("*", F.when(n >= 3, folder(3)).otherwise(F.lit(default_agent)).alias("agent"),
                    F.when(n >= 2, folder(2)).otherwise(stem).alias("trial"))
    return out.where(F.col("agent").isin(*agents)) if agents else out


def read_requests(spark: SparkSession, paths, root: str | None = None, agents=None,
                  default_agent: str = "") -> DataFrame:
    """The nested request log; blank and unparsable lines are dropped.

    The schema is given, so nothing is inferred, and unread top-level fields
    are not parsed (Spark prunes no deeper in JSON).  A broken line comes back
    with every field null; a record is told by its id, time, method or path.
    """
    df = spark.read.schema(REQUEST_RECORD).json(paths)
    df = label_from_layout(df, root, agents, default_agent) if root else df
    return df.where(F.coalesce("id", "timestamp", "http.method", "http.path").isNotNull())


def _event_columns() -> list[Column]:
    e = F.col("_ev")
    plain = {"type": "type", "target": "target", "x": "x", "y": "y", "px": "px", "py": "py",
             "button": "button", "key": "key", "code": "code", "ctrl": "ctrl", "shift": "shift",
             "alt": "alt", "meta": "meta", "value": "value", "scroll_x": "scrollX",
             "scroll_y": "scrollY", "el_scroll_top": "elScrollTop", "action": "action",
             "state": "state", "log_id": "logId", "log_event": "event", "detail": "detail",
             "win_w": "w", "win_h": "h", "referrer": "referrer", "url": "url"}
    text = {"type", "target"}
    return [(F.coalesce(e[src], F.lit("")) if src in text else e[src]).alias(name)
            for name, src in plain.items()]


def read_flushes(spark: SparkSession, paths, root: str | None = None, agents=None,
                 default_agent: str = "") -> DataFrame:
    """One row per flush, with its receipt time in microseconds."""
    df = spark.read.schema(FLUSH_RECORD).json(paths)
    df = label_from_layout(df, root, agents, default_agent) if root else df
    return (df.where(F.coalesce("session", "page", "receivedAt").isNotNull() | (F.size("batch") >= 0))
            .withColumn("received_us", F.unix_micros(event_time(F.col("receivedAt")))))


def explode_events(flushes: DataFrame, number_flushes: bool | None = None) -> DataFrame:
    """One row per event with flush data; event times are whole microseconds.

    A flush without a number is numbered by receipt time inside its trial, counted from
    zero over all flushes of the trial.  Unless told, a log is first asked whether it has
    such a flush, which reads the numbers alone; a log with all numbers is not shuffled.
    Streams are not numbered (it needs the whole trial).
    """
    keys = [c for c in ("agent", "trial") if c in flushes.columns]
    seq = F.col("flushSeq")
    if number_flushes is None:
        number_flushes = not flushes.isStreaming and not flushes.where("flushSeq IS NULL").select("flushSeq").isEmpty()
    if number_flushes:
        # flushes of one session received at once are told by their content
        flushes = ordered_columns(
            flushes.withColumn("_at", F.coalesce("received_us", F.lit(0)))
            .withColumn("_tie", F.struct("session", F.xxhash64("batch"))),
            running_count("_nth"), keys=keys or ["session"], time="_at", tie="_tie")
        seq = F.coalesce(seq.cast("long"), F.col("_nth") - 1)
    flat = flushes.select(
        *keys, F.coalesce("session", F.lit("")).alias("session"),
        F.coalesce("page", F.lit("")).alias("page_title"),
        page_label_column(F.col("page")).alias("page"), seq.cast("long").alias("flush_seq"),
        F.coalesce("flushReason", F.lit("")).alias("flush_reason"),
        F.coalesce("userAgent", F.lit("")).alias("user_agent"), "received_us",
        F.posexplode("batch").alias("_pos", "_ev"))
    us = F.coalesce(F.round(F.col("_ev.ms") * 1000).cast("long"),
                    F.unix_micros(event_time(F.col("_ev.t"))))
    return flat.select(
        *keys, F.concat_ws("/", "session", F.lpad(F.coalesce(F.col("flush_seq").cast("string"), F.lit("")), 9, "0"),
                           F.lpad(F.col("_pos").cast("string"), 6, "0")).alias("id"),
        us.alias("us"), "session", "page_title", "page", "flush_seq", "flush_reason", "user_agent",
        "received_us", *_event_columns())


def read_interactions(spark: SparkSession, paths, root: str | None = None, agents=None,
                      default_agent: str = "") -> DataFrame:
    return explode_events(read_flushes(spark, paths, root, agents, default_agent))


_RUN = T.StructType([T.StructField(n, T.StringType()) for n in
                     ("agent", "trial_id", "timestamp_utc", "task_prompt", "transcript")])


def _python_datetime(text: Column) -> Column:
    """Text such as `datetime.datetime(2026, 4, 19, 4, 54, 7, 531326)`."""
    n = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda v: v.try_cast("int"))

    def at(i: int) -> Column:
        return F.coalesce(F.get(n, i), F.lit(0))

    seconds = at(5).cast("decimal(8,6)") + (at(6) / F.lit(1_000_000)).cast("decimal(8,6)")
    return F.when(text.rlike(r"^datetime\.datetime\("),
                  F.try_make_timestamp(at(0), at(1), at(2), at(3), at(4), seconds))


def read_run_windows(spark: SparkSession, path, collected: bool = False) -> DataFrame:
    """(agent, trial, s_us, e_us) per run document.

    The start sits in one of four places depending on the client; the first
    present one is taken.  The file, or a folder for it, is named <agent>__<trial>__<time>.
    Collected documents stand one in a line, many in a file, each with that name as
    `run`: files then grow with the bytes, not with the runs.
    """
    if collected:
        docs, run = spark.read.schema(T.StructType([*_RUN, T.StructField("run", T.StringType())])).json(path), F.col("run")
    else:
        docs = spark.read.schema(_RUN).option("multiLine", True).json(path)
        run = F.regexp_extract(_file_path(), r"([^/=]+__[^/]+)(/[^/]*)?$", 1)
    name = F.split(run, "__")

    def field(p: str) -> Column:
        return F.get_json_object("transcript", p)

    start = F.coalesce(
        F.unix_micros(event_time(field("$[0].timestamp_utc"))),
        F.unix_micros(_python_datetime(field("$.created_at"))),
        F.round(field("$.history[0].metadata.step_start_time").try_cast("double") * 1_000_000).cast("long"),
        F.unix_micros(event_time(field("$[0].started_at_utc"))))
    return docs.select(F.get(name, 0).alias("agent"), F.get(name, 1).alias("trial"), start.alias("s_us"),
                       F.unix_micros(event_time(F.col("timestamp_utc"))).alias("e_us"))


def _numbered_lines(spark: SparkSession, path) -> DataFrame:
    """(line_no, line) of small control files; a file holds one line per trial."""
    return (spark.read.text(path, wholetext=True)
            .select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
            .where(F.trim("line") != ""))


def read_manifest(spark: SparkSession, path, agent: str = "") -> DataFrame:
    """Trial windows from tab-separated trial, start, end and exit code.

    A re-run trial keeps its last line; lines with fewer than three fields are skipped.
    """
    parts = F.split(F.trim("line"), "\t")
    rows = (_numbered_lines(spark, path).where(F.size(parts) >= 3)
            .select(F.get(parts, 0).try_cast("int").alias("n"), F.struct(
                "line_no", F.unix_micros(event_time(F.get(parts, 1))).alias("s_us"),
                F.unix_micros(event_time(F.get(parts, 2))).alias("e_us"),
                F.coalesce(F.get(parts, 3), F.lit("")).alias("rc")).alias("w")))
    return (rows.where(F.col("n").isNotNull()).groupBy("n").agg(F.max("w").alias("w"))
            .select(F.lit(agent).alias("agent"), F.col("n").alias("trial"),
                    "w.s_us", "w.e_us", "w.rc"))


def read_local_windows(spark: SparkSession, path, agent: str, year: int, tz: str,
                       pad_seconds: int = 59, names=None) -> DataFrame:
    """Windows written as local text `M/D HH:MM - HH:MM` (hyphen or dash).

    The end is padded because only minutes were noted.  Trials are numbered by
    line, or named from `names` in line order.
    """
    parts = F.split(F.trim("line"), r"\s+")
    rows = _numbered_lines(spark, path).where(F.size(parts) == 4)

    def utc(clock: Column) -> Column:
        local = F.try_to_timestamp(F.concat_ws(" ", F.concat_ws("/", F.lit(str(year)), F.get(parts, 0)), clock),
                                   F.lit("yyyy/M/d H:mm"))
        return F.unix_micros(F.to_utc_timestamp(local, tz))

    trial = (F.get(F.array(*[F.lit(n) for n in names]), F.col("line_no")) if names else
             F.concat(F.lit("trial-"), F.lpad((F.col("line_no") + 1).cast("string"), 3, "0")))
    return rows.select(F.lit(agent).alias("agent"), trial.alias("trial"), utc(F.get(parts, 1)).alias("s_us"),
                       (utc(F.get(parts, 3)) + pad_seconds * 1_000_000).alias("e_us"))
