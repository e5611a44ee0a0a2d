"""Overlap of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Pairs of rows with left.start <= right.to and left.end >= right.from (whole numbers, ends included).

    Both sides are dealt into cells of `width`; a pair meets in the first cell that both cover, and only there, so it is found once and no plan is
    quadratic in rows that do not meet. Width should be near the usual length of an interval.
    """

    def cells(low: str, high: str):
        return F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))

    a = left.where(F.col("start") <= F.col("end")).withColumn("cell", cells("start", "end"))
    b = right.where(F.col("from") <= F.col("to")).withColumn("cell", cells("from", "to"))
    met = a.join(b, "cell").where((F.col("start") <= F.col("to")) & (F.col("end") >= F.col("from")))
    return met.where(F.col("cell") == F.floor(F.greatest("start", "from") / width)).drop("cell")
