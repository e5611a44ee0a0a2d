"""Joins on hierarchical keys. Prefix predicates are turned into equalities on exploded prefixes, so no plan holds a nested-loop join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import paths


def closure(nodes: DataFrame, path: str) -> DataFrame:
    """The distinct paths of nodes and all their ancestors, the root included."""
    return nodes.select(F.explode(paths.prefixes(path)).alias(path)).distinct()


def subtree(rows: DataFrame, path: str, scope: list[str], depth: int | None = None) -> DataFrame:
    """Rows whose path is scope or lies below it, at most depth segments deeper."""
    inside = rows.where(paths.is_under(path, F.array(*map(F.lit, scope)).cast("array<string>")))
    return inside if depth is None else inside.where(F.size(path) <= len(scope) + depth)


def rollup(rows: DataFrame, path: str, **totals: Column) -> DataFrame:
    """Aggregates of all rows at or below every node. totals: name = aggregate over the other columns."""
    return rows.withColumn("node", F.explode(paths.prefixes(path))).groupBy("node").agg(*(c.alias(n) for n, c in totals.items()))


def deepest_ancestor(rows: DataFrame, path: str, known: DataFrame, key: list[str]) -> DataFrame:
    """rows with `found`, the longest prefix of path that known (column path) has, and `symbol`, the segment after it; both null without one.

    key: columns that identify a row. Of the prefixes of a row only the lengths travel, and the longest is taken by partial maxima.
    """
    hits = rows.select(*key, path).withColumn("prefix", F.explode(paths.prefixes(path))).join(known.select(F.col(path).alias("prefix")).distinct(), "prefix")
    best = hits.groupBy(*key).agg(F.max(F.size("prefix")).alias("n"))
    joined = rows.join(best, key, "left")
    return joined.withColumns({"found": F.when(F.col("n").isNotNull(), F.slice(path, F.lit(1), F.coalesce("n", F.lit(0)))), "symbol": F.get(F.col(path), F.col("n"))}).drop("n")


def longest_rule(rows: DataFrame, path: str, rules: DataFrame, key: list[str]) -> DataFrame:
    """rows with the rule that fits best. rules: prefix (array), exact (boolean), target (array).

    An exact rule fits only the path itself, others every path below too. Longest prefix first, then the smaller prefix. `expanded`: target, and for
    a rule that is not exact the rest of the path. Null where no rule fits.
    """
    at = rows.select(*key, path).withColumn("prefix", F.explode(paths.prefixes(path)))
    fits = at.join(rules, "prefix").where(~F.col("exact") | (F.col("prefix") == F.col(path)))
    best = fits.groupBy(*key).agg(F.min_by(F.struct("prefix", "exact", "target"), F.struct(-F.size("prefix"), "prefix", "target")).alias("rule"))
    joined = rows.join(best, key, "left")
    rest = F.slice(F.col(path), F.size("rule.prefix") + 1, F.size(path))
    return joined.withColumn("expanded", F.when(F.col("rule.exact"), F.col("rule.target")).when(F.col("rule").isNotNull(), F.concat("rule.target", rest)))


def by_suffix(nodes: DataFrame, path: str, query: list[str], anchored: bool = False) -> DataFrame:
    """Nodes whose path ends with query; anchored: is query. Of several, only the one that is query itself, if there is one."""
    want = F.array(*map(F.lit, query)).cast("array<string>")
    hits = nodes.where(F.col(path) == want) if anchored else nodes.where(paths.has_suffix(path, want))
    exact = hits.where(F.col(path) == want)
    return hits if anchored or exact.isEmpty() else exact


def inherited_visibility(rows: DataFrame, owners: DataFrame, on: list[str], own: str = "vis", above: str = "owner_vis", otherwise: int = 0) -> DataFrame:
    """rows with vis cut down to the owner's; an unknown owner counts as `otherwise`."""
    return rows.join(owners, on, "left").withColumn(own, F.least(own, F.coalesce(F.col(above), F.lit(otherwise)))).drop(above)
