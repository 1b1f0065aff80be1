"""Written intermediate tables of large steps."""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from tracefp.session import materialize


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """df written to the shared folder and read back.  Spark removes the shuffle files
    of a finished job when its plan is collected as garbage, which a quiet driver may
    not do for long; asking for it here keeps the disk to the files still of use."""
    out = materialize(df, purpose)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_kept: dict[str, Any] = {}


def kept_in_worker(key: str, make: Callable[[], Any]) -> Any:
    """make()'s result, kept between the tasks of a Python worker.  A worker serves one
    operator after another, so only the last key's is kept."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]
