"""Queries over a dependency graph: nations of customers depend on nations of suppliers by way of order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import graph
from quillon.runtime import materialize


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = spark.read.parquet(f"{sf}/nation.parquet"), spark.read.parquet(f"{sf}/region.parquet")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.array("r_name", "n_name").alias("node"))


#: Lines that one task joins, about.
TASK_LINES = 1_000_000


def _uses(spark: SparkSession, sf: str) -> DataFrame:
    """source, target (paths of region and nation), l_orderkey, o_orderpriority of every line; dealt out by l_orderkey.

    Only keys go through the large joins, in as many parts as keep the lines of one within TASK_LINES; names come behind them.
    """
    read = lambda t, *c: spark.read.parquet(f"{sf}/{t}.parquet").select(*c)
    nodes = _nodes(spark, sf)
    lines, orders = read("lineitem", "l_orderkey", "l_suppkey"), read("orders", "o_orderkey", "o_custkey", "o_orderpriority")
    parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // TASK_LINES))
    lines = lines.join(read("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    orders = orders.join(read("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", "o_orderpriority")
    met = lines.repartition(parts, "l_orderkey").join(orders.repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = met.join(F.broadcast(nodes.toDF("c_nationkey", "source")), "c_nationkey").join(F.broadcast(nodes.toDF("s_nationkey", "target")), "s_nationkey")
    return named.select("source", "target", "l_orderkey", "o_orderpriority")


def _sparse(spark: SparkSession, sf: str) -> DataFrame:
    """One edge from each nation to the other nation that supplies most of its lines (then the smaller name)."""
    pairs = _uses(spark, sf).where("source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))
    best = pairs.groupBy("source").agg(F.min_by("target", F.struct(-F.col("n"), F.element_at("target", 2))).alias("target"))
    return best


def _names(df: DataFrame, *ends: str) -> DataFrame:
    return df.withColumns({e: F.element_at(e, 2) for e in ends})


def dep_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct edges with the number of lines that make them."""
    return _names(_uses(spark, sf).groupBy("source", "target").agg(F.count("*").alias("lines")), "source", "target")


def deps_outgoing(spark: SparkSession, sf: str) -> DataFrame:
    """What Europe depends on: regions at the first level, by distinct orders."""
    out = graph.grouped(graph.crossing(_uses(spark, sf), ["EUROPE"]), "target", ["EUROPE"], 0, F.count_distinct("l_orderkey").alias("orders"))
    return out.select(F.array_join("key", "::").alias("key"), "orders").orderBy(F.desc("orders"), "key")


def deps_incoming(spark: SparkSession, sf: str) -> DataFrame:
    """What depends on Asia: nations, with the first order and the sorted priorities of the orders."""
    out = graph.grouped(graph.crossing(_uses(spark, sf), ["ASIA"], incoming=True), "source", ["ASIA"], 1, F.min("l_orderkey").alias("first_order"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ").alias("priorities"))
    return out.select(F.array_join("key", "::").alias("key"), "first_order", "priorities")


def fan_in_out(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct nations on both ends of all edges."""
    return _names(graph.fan(_uses(spark, sf).select("source", "target")), "node")


def dependency_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Outgoing edges of every region grouped at both levels below the root: distinct orders and nations."""
    part = lambda c, n: F.get(c, F.lit(n))
    uses = _uses(spark, sf).where(part("source", 0) != part("target", 0)).select("l_orderkey", part("source", 0).alias("scope"), part("target", 0).alias("region"), part("target", 1).alias("nation"))
    # the lines of an order are in one task: there each order becomes a row for each of its regions, and counting needs no distinct
    orders = uses.groupBy("l_orderkey", "scope", "region", "nation").agg(F.lit(1).alias("one")).groupBy("l_orderkey", "scope", "region").agg(F.collect_list("nation").alias("nations"))
    levels = orders.select("scope", "region", F.explode(F.concat("nations", F.array(F.lit(None).cast("string")))).alias("nation"))
    return levels.groupBy("scope", "region", "nation").agg(F.count("*").alias("orders"))


def externals_split(spark: SparkSession, sf: str) -> DataFrame:
    """Brands by the suppliers that ship them; returned lines play the tests."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("test"))
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand")
    return graph.externals(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), "p_brand", "l_suppkey", "test")


def sibling_shape(spark: SparkSession, sf: str) -> DataFrame:
    """The shape that the sparse edges make of the nations of each region's siblings at the root: regions as children."""
    edges = materialize(graph.siblings(_sparse(spark, sf), []), "siblings")
    nodes = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_name").alias("node"))
    return graph.shape(nodes, edges)


def reachability(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reachable(_names(_sparse(spark, sf), "source", "target"))


def cycles(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cycles(_names(_sparse(spark, sf), "source", "target"))


_U = """u AS (SELECT rc.r_name AS sr, nc.n_name AS sn, rs.r_name AS tr, ns.n_name AS tn, l_orderkey, o_orderpriority FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation nc ON nc.n_nationkey = c_nationkey JOIN region rc ON rc.r_regionkey = nc.n_regionkey
  JOIN nation ns ON ns.n_nationkey = s_nationkey JOIN region rs ON rs.r_regionkey = ns.n_regionkey)"""
_S = f"""{_U}, e AS (SELECT sr, sn, tr, tn FROM (SELECT sr, sn, tr, tn, row_number() OVER (PARTITION BY sr, sn ORDER BY count(*) DESC, tn) AS k
  FROM u WHERE (sr, sn) <> (tr, tn) GROUP BY sr, sn, tr, tn) WHERE k = 1)"""
_R = f"""{_S}, r(source, target) AS (SELECT sn, tn FROM e UNION SELECT r.source, e.tn FROM r JOIN e ON e.sn = r.target)"""

QUERIES = {
    "dep_edges": dep_edges,
    "deps_outgoing": deps_outgoing,
    "deps_incoming": deps_incoming,
    "fan_in_out": fan_in_out,
    "dependency_tree": dependency_tree,
    "externals_split": externals_split,
    "sibling_shape": sibling_shape,
    "reachability": reachability,
    "cycles": cycles,
}
ORACLES = {
    "dep_edges": f"WITH {_U} SELECT sn AS source, tn AS target, count(*) AS lines FROM u GROUP BY sn, tn",
    "deps_outgoing": f"WITH {_U} SELECT tr AS key, count(DISTINCT l_orderkey) AS orders FROM u WHERE sr = 'EUROPE' AND tr <> 'EUROPE' GROUP BY tr",
    "deps_incoming": f"""WITH {_U} SELECT sr || '::' || sn AS key, min(l_orderkey) AS first_order, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities
FROM u WHERE tr = 'ASIA' AND sr <> 'ASIA' GROUP BY sr, sn""",
    "fan_in_out": f"""WITH {_U}, h AS (SELECT DISTINCT sn, tn FROM u WHERE sn <> tn),
x AS (SELECT sn AS node, 1 AS o, 0 AS i FROM h UNION ALL SELECT tn, 0, 1 FROM h) SELECT node, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i) AS BIGINT) AS fan_in FROM x GROUP BY node""",
    "dependency_tree": f"WITH {_U} SELECT sr AS scope, tr AS region, tn AS nation, count(DISTINCT l_orderkey) AS orders FROM u WHERE sr <> tr GROUP BY GROUPING SETS ((sr, tr), (sr, tr, tn))",
    "externals_split": """WITH x AS (SELECT p_brand, count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_suppkey END) AS main_uses, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS test_uses
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand) SELECT p_brand, main_uses, test_uses, main_uses = 0 AS tests_only FROM x""",
    "sibling_shape": f"""WITH RECURSIVE {_S}, s AS (SELECT DISTINCT sr AS a, tr AS b FROM e WHERE sr <> tr), r(a, b) AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON s.a = r.b),
t AS (SELECT (SELECT count(*) FROM region) AS nodes, (SELECT count(*) FROM s) AS edges, (SELECT count(DISTINCT b) FROM s) AS hubs, (SELECT count(DISTINCT x.a) FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b) AS cyclic)
SELECT nodes, edges, hubs, nodes - hubs AS leaves, cyclic, CASE WHEN nodes < 2 THEN 'none' WHEN cyclic > 0 THEN 'mesh' WHEN edges = 0 THEN 'flat' WHEN hubs <= 2 AND nodes - hubs >= 2 THEN 'star' ELSE 'layered' END AS shape FROM t""",
    "reachability": f"WITH RECURSIVE {_R} SELECT source, target FROM r",
    "cycles": f"WITH RECURSIVE {_R} SELECT x.source AS node, least(min(x.target), x.source) AS cycle FROM r x JOIN r y ON x.source = y.target AND x.target = y.source WHERE x.source <> x.target GROUP BY x.source",
}
