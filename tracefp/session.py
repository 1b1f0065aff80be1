"""Session defaults and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job in the package relies on.  Sizes are left to the cluster.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when the split costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # plans here hold thousands of columns; call sites are not recorded for each
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "tracefp", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings above; extra settings are passed as keywords
    with dots written as double underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_local_root: str | None = None


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below the checkpoint folder the cluster names.

    Executors must be able to read what other executors wrote, so a
    machine-local folder is used only when the whole session runs on one
    machine; elsewhere a missing setting is an error.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _local_root = _local_root or tempfile.mkdtemp(prefix="tracefp-")
        root = _local_root
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Written to the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.parquet(path)
