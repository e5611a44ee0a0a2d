"""Differences of two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(current: DataFrame, base: DataFrame, unit: str, key: list[str], value: str) -> DataFrame:
    """current with `state`: new_unit (base has no row of the unit), new (base has not the key), changed (another value) or same.

    Of several base rows of a key the one with the greatest value counts.
    """
    units = base.select(unit).distinct().withColumn("__unit", F.lit(True))
    values = base.groupBy(unit, *key).agg(F.max(F.struct(value)).alias("__base"))
    joined = current.join(values, [unit, *key], "left").join(units, unit, "left")
    state = F.when(F.col("__unit").isNull(), "new_unit").when(F.col("__base").isNull(), "new").when(~F.col(f"__base.{value}").eqNullSafe(F.col(value)), "changed").otherwise("same")
    return joined.withColumn("state", state).drop("__unit", "__base")


def change_counts(states: DataFrame, unit: str) -> DataFrame:
    """One row: units with a change and new units."""
    return states.where("state <> 'same'").agg(F.count_distinct(unit).alias("changed_units"), F.count_distinct(F.when(F.col("state") == "new_unit", F.col(unit))).alias("new_units"))
