"""Counters over logs of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_total(rows: DataFrame, by: str, counters: dict[str, Column], label: str = "total") -> DataFrame:
    """A row of counters for each value of by, and one labelled for all."""
    made = rows.rollup(by).agg(F.grouping(by).alias("__all"), *(c.alias(n) for n, c in counters.items()))
    return made.withColumn(by, F.when(F.col("__all") == 1, label).otherwise(F.col(by).cast("string"))).drop("__all")


def floor_share(part: str, whole: str) -> Column:
    """Whole percents, rounded down, or - without a whole."""
    return F.when(F.col(whole) > 0, F.floor(F.col(part) * 100 / F.col(whole)).cast("string")).otherwise("-")


def touched(paths: DataFrame, edited: DataFrame, path: str) -> DataFrame:
    """paths that were edited."""
    return paths.join(edited.select(path).distinct(), path, "left_semi")
