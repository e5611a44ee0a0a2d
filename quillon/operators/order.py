"""Operators that depend on the order of rows. The order is always given by columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions import paths


def runs(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """rows with `run`, the number of the stretch of equal values in a row it is in (from 1) within by."""
    w = W.partitionBy(*by).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("run", F.sum(changed).over(w.rowsBetween(W.unboundedPreceding, 0)))


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. By partial minima: a key with very many rows is one row of each task before it moves."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return best.select(*key, "__first.*").select(*rows.columns)


def without_repeats(rows: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """rows without those whose values equal the row's before them within by."""
    w = W.partitionBy(*by).orderBy(*order)
    both = F.struct(*values)
    return rows.withColumn("__before", F.lag(both).over(w)).where(F.col("__before").isNull() | ~F.col("__before").eqNullSafe(both)).drop("__before")


def path_order(rows: DataFrame, text: str) -> DataFrame:
    """rows ordered by the parts of a path, so that what is below a/b stands before a.x."""
    return rows.withColumn("parts", paths.segments(text)).orderBy("parts", text)
