"""Aggregates over rows that may stand for several, counted before they were parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHT = "weight"


class Weighted:
    """Aggregates of a frame whose ``weight`` column, where it has one, tells how many rows
    a row stands for; the results are those of the rows themselves."""

    def __init__(self, df: DataFrame) -> None:
        self.name = WEIGHT if WEIGHT in df.columns else None
        self.weight = F.col(WEIGHT) if self.name else F.lit(1).cast("long")

    def count(self, when: Column | None = None) -> Column:
        """Rows, or those for which ``when`` is true."""
        return F.coalesce(F.sum(self.weight if when is None else F.when(when, self.weight)), F.lit(0))

    def avg(self, value: Column | str) -> Column:
        """Mean of the values that are there; of a flag its share."""
        value = F.col(value) if isinstance(value, str) else value
        return F.sum(value.cast("double") * self.weight) / F.sum(F.when(value.isNotNull(), self.weight))

    def share(self, flag: Column | str) -> Column:
        return self.avg((F.col(flag) if isinstance(flag, str) else flag).cast("int"))

    def stddev_samp(self, value: str) -> Column:
        """Of a whole number, whose sums are exact; null for fewer than two values."""
        x = F.col(value).cast("decimal(19,0)")
        n = self.count(x.isNotNull())
        total, squares = F.sum(x * self.weight).cast("double"), F.sum(x * x * self.weight).cast("double")
        return F.when(n > 1, F.sqrt(F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0))))
