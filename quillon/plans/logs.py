"""Queries over events, conversations and orders as logs and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import diff, hierarchy, order, ranges, usage


def _read(spark: SparkSession, sf: str, table: str, *columns) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet").select(*columns)


def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Orders against a base that lacks customers divisible by 7 and orders divisible by 5, and has other prices where the key is divisible by 3."""
    now = _read(spark, sf, "orders", "o_custkey", "o_orderkey", F.concat_ws("|", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("signature"))
    base = now.where("o_custkey % 7 <> 0 AND o_orderkey % 5 <> 0").withColumn("signature", F.when(F.col("o_orderkey") % 3 == 0, F.lit("old")).otherwise(F.col("signature")))
    return diff.changed(now, base, "o_custkey", ["o_orderkey"], "signature").select("o_custkey", "o_orderkey", "state")


def change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return diff.change_counts(snapshot_diff(spark, sf), "o_custkey")


def run_grouping(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of one event type of a user: first event, how many, and their ids."""
    marked = order.runs(_read(spark, sf, "events", "event_id", "ts", "user_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    out = marked.groupBy("user_id", "run", "event_type").agg(F.min("event_id").alias("low_id"), F.count("*").alias("events"))
    return out


def first_wins_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The first event of each type of a user."""
    return order.first_wins(_read(spark, sf, "events", "event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def consecutive_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Events without those of the same type as the user's event before."""
    return order.without_repeats(_read(spark, sf, "events", "event_id", "ts", "user_id", "event_type"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "user_id")


def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose time from ordering to last shipping meets fixed windows of 10 days, counted."""
    day = lambda c: F.datediff(c, F.lit("1990-01-01").cast("date"))
    last = _read(spark, sf, "lineitem", "l_orderkey", "l_shipdate").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ship"))
    spans = _read(spark, sf, "orders", "o_orderkey", "o_orderdate").join(last, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", day("o_orderdate").cast("long").alias("start"), day("ship").cast("long").alias("end"))
    windows = spark.range(0, 40).select(F.col("id").alias("window"), (F.col("id") * 100).alias("from"), (F.col("id") * 100 + 9).alias("to"))
    return ranges.overlapping(spans, windows, 64).groupBy("window").agg(F.count("*").alias("orders"), F.min("o_orderkey").alias("first_order"))


def usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Turns by role and mentions of `the` in each conversation and in all, with the user's share of turns."""
    rows = _read(spark, sf, "conversations", "conv_id", "role", "text")
    counters = {"turns": F.count("*"), "user_turns": F.count_if(F.col("role") == "user"), "mentions": F.sum(F.regexp_count("text", F.lit(r"\bthe\b"))).cast("long")}
    out = usage.with_total(rows, "conv_id", counters)
    return out.withColumn("share", usage.floor_share("user_turns", "turns"))


def session_touched(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations whose number is a user with a purchase."""
    made = _read(spark, sf, "events", F.col("user_id").alias("conv_id"), "event_type").where("event_type = 'purchase'")
    return usage.touched(_read(spark, sf, "conversations", "conv_id").distinct(), made, "conv_id")


def least_visibility(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' visibility (from the balance) cut down to their nation's (from its key); odd nations are unknown."""
    rows = _read(spark, sf, "customer", "c_custkey", F.col("c_nationkey").alias("k"), F.when(F.col("c_acctbal") > 5000, 2).when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("vis"))
    owners = _read(spark, sf, "nation", F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 3).cast("int").alias("owner_vis")).where("k % 2 = 0")
    return hierarchy.inherited_visibility(rows, owners, ["k"]).select("c_custkey", "vis")


_R = """r AS (SELECT event_id, ts, user_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
_D = """n AS (SELECT o_custkey, o_orderkey, o_orderstatus || '|' || CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS signature FROM orders),
b AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE signature END AS signature FROM n WHERE o_custkey % 7 <> 0 AND o_orderkey % 5 <> 0),
d AS (SELECT n.o_custkey, n.o_orderkey, CASE WHEN n.o_custkey NOT IN (SELECT o_custkey FROM b) THEN 'new_unit' WHEN b.o_orderkey IS NULL THEN 'new' WHEN b.signature IS DISTINCT FROM n.signature THEN 'changed' ELSE 'same' END AS state
  FROM n LEFT JOIN b ON b.o_custkey = n.o_custkey AND b.o_orderkey = n.o_orderkey)"""
_C = "count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, CAST(sum(len(regexp_extract_all(text, '\\bthe\\b'))) AS BIGINT) AS mentions"

QUERIES = {
    f.__name__: f
    for f in (snapshot_diff, change_counts, run_grouping, first_wins_dedup, consecutive_dedup, interval_overlap, usage_rollup, session_touched, least_visibility)
}
ORACLES = {
    "snapshot_diff": f"WITH {_D} SELECT o_custkey, o_orderkey, state FROM d",
    "change_counts": f"WITH {_D} SELECT count(DISTINCT o_custkey) AS changed_units, count(DISTINCT CASE WHEN state = 'new_unit' THEN o_custkey END) AS new_units FROM d WHERE state <> 'same'",
    "run_grouping": f"""WITH {_R}, s AS (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM r)
SELECT user_id, run, event_type, min(event_id) AS low_id, count(*) AS events FROM s GROUP BY user_id, run, event_type""",
    "first_wins_dedup": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1",
    "consecutive_dedup": f"WITH {_R} SELECT event_id, user_id FROM r WHERE c = 1",
    "interval_overlap": """WITH s AS (SELECT o_orderkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS a, date_diff('day', DATE '1990-01-01', CAST(max(l_shipdate) AS DATE)) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate),
w AS (SELECT range AS w, range * 100 AS f, range * 100 + 9 AS t FROM range(0, 40))
SELECT w AS "window", count(*) AS orders, min(o_orderkey) AS first_order FROM s JOIN w ON a <= t AND b >= f AND a <= b GROUP BY w""",
    "usage_rollup": f"""WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, {_C} FROM conversations GROUP BY conv_id UNION ALL SELECT 'total', {_C} FROM conversations)
SELECT *, CASE WHEN turns > 0 THEN CAST(user_turns * 100 // turns AS VARCHAR) ELSE '-' END AS share FROM c""",
    "session_touched": "SELECT DISTINCT conv_id FROM conversations WHERE conv_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')",
    "least_visibility": """SELECT c_custkey, least(CASE WHEN c_acctbal > 5000 THEN 2 WHEN c_acctbal > 0 THEN 1 ELSE 0 END, coalesce(n_nationkey % 3, 0)) AS vis
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n ON n_nationkey = c_nationkey""",
}
