"""Dependency edges between hierarchical nodes: grouping, fan-in and fan-out, reachability, cycles and shape.

Edges are (source, target, ...) rows; sources and targets of one pair may repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.runtime import materialize


def crossing(edges: DataFrame, scope: list[str], incoming: bool = False) -> DataFrame:
    """Edges that leave the subtree of scope, or with incoming those that enter it."""
    want = F.array(*map(F.lit, scope)).cast("array<string>")
    inside, outside = ("target", "source") if incoming else ("source", "target")
    return edges.where(paths.is_under(inside, want) & ~paths.is_under(outside, want))


def grouped(edges: DataFrame, end: str, scope: list[str], extra: int, *totals) -> DataFrame:
    """Edges grouped by their end, cut `extra` + 1 segments below where it leaves scope."""
    key = paths.group_key(end, F.array(*map(F.lit, scope)).cast("array<string>"), extra)
    return edges.groupBy(key.alias("key")).agg(*totals)


def fan(edges: DataFrame) -> DataFrame:
    """For every node: distinct nodes it depends on (fan_out) and that depend on it (fan_in), itself left out."""
    pairs = edges.select("source", "target").where("source <> target").distinct()
    ends = pairs.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(pairs.select("target", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))


def siblings(edges: DataFrame, scope: list[str]) -> DataFrame:
    """Distinct edges between unlike direct children of scope."""
    want = F.array(*map(F.lit, scope)).cast("array<string>")
    inside = edges.where(paths.is_under("source", want) & paths.is_under("target", want))
    children = inside.select(F.get("source", F.lit(len(scope))).alias("source"), F.get("target", F.lit(len(scope))).alias("target"))
    return children.where("source IS NOT NULL AND target IS NOT NULL AND source <> target").distinct()


def reachable(edges: DataFrame) -> DataFrame:
    """(source, target): target can be reached from source in one step or more. Paths are doubled, so rounds grow with the logarithm of the longest."""
    known = materialize(edges.select("source", "target").distinct(), "reach")
    size = known.count()
    while True:
        longer = known.select("source", F.col("target").alias("via")).join(known.select(F.col("source").alias("via"), "target"), "via").select("source", "target")
        known = materialize(known.union(longer).distinct(), "reach")
        grown = known.count()
        if grown == size:
            return known
        size = grown


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges without those that no cycle can hold: their source has no edge to it or their target none from it."""
    size = edges.count()
    while size:
        kept = edges.join(edges.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(edges.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        edges = materialize(kept.select("source", "target"), "trimmed")
        left = edges.count()
        if left == size:
            break
        size = left
    return edges


def _spread(edges: DataFrame, start: DataFrame) -> DataFrame:
    """start (node, label) with labels passed on along edges until every node has the smallest that reaches it."""
    labels = materialize(start, "labels")
    while True:
        told = edges.join(labels.withColumnRenamed("node", "source"), "source").select(F.col("target").alias("node"), F.col("label").alias("told")).groupBy("node").agg(F.min("told").alias("told"))
        both = labels.join(told, "node", "full").select("node", F.least("label", "told").alias("label"), (F.col("label").isNull() | (F.col("told") < F.col("label"))).alias("moved"))
        both = materialize(both, "labels")
        labels = both.select("node", "label")
        if both.where("moved").isEmpty():
            return labels


def cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle): nodes that reach themselves by way of another, with the smallest node they share a cycle with.

    Nodes and edges only, never pairs of nodes: what no cycle can hold is trimmed off; every node takes the smallest node that reaches it as its
    colour; those that reach the node of their colour within the colour share its cycle. They leave, and the rest goes on.
    """
    found: list[DataFrame] = []
    left = _trimmed(materialize(edges.where("source <> target").select("source", "target").distinct(), "edges"))
    while not left.isEmpty():
        nodes = left.select(F.col("source").alias("node")).union(left.select("target")).distinct()
        colour = _spread(left, nodes.withColumn("label", F.col("node")))
        ends = left.join(colour.toDF("source", "a"), "source").join(colour.toDF("target", "b"), "target")
        same = materialize(ends.where("a = b").select(F.col("target").alias("source"), F.col("source").alias("target")), "same")  # turned round
        back = _spread(same, colour.where("node = label"))
        cycle = materialize(back.select("node", F.col("label").alias("cycle")), "cycle")
        shared = cycle.groupBy("cycle").agg(F.count("*").alias("n")).where("n > 1").select("cycle")
        found.append(cycle.join(shared, "cycle", "left_semi"))
        gone = cycle.select("node")
        left = left.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti")
        left = _trimmed(materialize(left.select("source", "target"), "edges"))
    if not found:
        return edges.limit(0).select(F.col("source").alias("node"), F.col("target").alias("cycle"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("node", "cycle")


def shape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, hubs (targets), leaves (the others), cyclic nodes, and the class they make.

    nodes (column node) are the direct children of a scope, edges its siblings(). Fewer than two children: none; a cycle: mesh; no edge: flat;
    at most two hubs and two leaves or more: star; else layered.
    """
    empty = {n: F.lit(None).cast("long") for n in ("nodes", "edges", "hubs", "cyclic")}

    def part(df: DataFrame, **made) -> DataFrame:
        return df.select(*((made | {k: v for k, v in empty.items() if k not in made})[n].alias(n) for n in empty))

    rows = part(nodes.agg(F.count("*").alias("n")), nodes=F.col("n"))
    rows = rows.union(part(edges.agg(F.count("*").alias("n"), F.count_distinct("target").alias("h")), edges=F.col("n"), hubs=F.col("h")))
    rows = rows.union(part(cycles(edges).agg(F.count("*").alias("n")), cyclic=F.col("n")))
    totals = rows.agg(*(F.max(n).alias(n) for n in empty)).withColumn("leaves", F.col("nodes") - F.col("hubs"))
    kind = F.when(F.col("nodes") < 2, "none").when(F.col("cyclic") > 0, "mesh").when(F.col("edges") == 0, "flat").when((F.col("hubs") <= 2) & (F.col("leaves") >= 2), "star").otherwise("layered")
    return totals.select("nodes", "edges", "hubs", "leaves", "cyclic", kind.alias("shape"))


def externals(uses: DataFrame, name: str, where: str, in_test: str) -> DataFrame:
    """For each external name: distinct places that use it outside of tests and in tests, and whether only tests do. Ordered: real uses first, most used, name."""
    main, test = F.count_distinct(F.when(~F.col(in_test), F.col(where))), F.count_distinct(F.when(F.col(in_test), F.col(where)))
    out = uses.groupBy(name).agg(main.alias("main_uses"), test.alias("test_uses")).where("main_uses > 0 OR test_uses > 0")
    return out.withColumn("tests_only", F.col("main_uses") == 0).orderBy("tests_only", F.desc(F.when(F.col("main_uses") > 0, F.col("main_uses")).otherwise(F.col("test_uses"))), name)
