"""Column jobs over browser events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefp.operators.ordered import first_time, ordered_columns
from tracefp.schema import PAGE_LABELS, TRIAL_KEY


def page_label_column(title: Column) -> Column:
    """Short label of a page title: the table first, else its last dotted part."""
    table = F.create_map(*[F.lit(x) for pair in PAGE_LABELS.items() for x in pair])
    title = F.coalesce(title, F.lit(""))
    tail = F.element_at(F.split(title, "·", -1), -1)
    return F.coalesce(F.try_element_at(table, title), F.substring(F.trim(tail), 1, 30))


def page_label(df: DataFrame, title: str = "page_title", out: str = "page") -> DataFrame:
    return df.withColumn(out, page_label_column(F.col(title)))


def is_page_load() -> Column:
    return F.coalesce((F.col("type") == "page") & (F.col("action") == "load"), F.lit(False))


def app_event_funnel(df: DataFrame, keys=TRIAL_KEY) -> DataFrame:
    """Custom application events with milliseconds since the trial began."""
    timed = ordered_columns(df, first_time("start_us"), keys=keys)
    cols = [c for c in ("log_id",) if c in df.columns]
    return (timed.where(F.col("type") == "app_event")
            .select(*keys, "id", "page", *cols, F.col("log_event").alias("app_event"),
                    F.col("detail").alias("app_detail"),
                    ((F.col("us") - F.col("start_us")) / 1000).alias("ms_rel")))


def input_event_monitor(df: DataFrame) -> DataFrame:
    """Form input and application events only; stateless, so it also runs on streams."""
    wanted = [c for c in ("agent", "trial", "id", "us", "session", "page", "type", "target",
                          "value", "log_id", "log_event", "detail") if c in df.columns]
    return df.where(F.col("type").isin("input", "change", "app_event")).select(*wanted)
