"""Queries over the hierarchies of urls and of part types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions import paths
from quillon.operators import code, documents, hierarchy, order
from quillon.runtime import materialize


def _pages(spark: SparkSession, sf: str, *more) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", paths.url_path("url").alias("path"), *more)


def path_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and characters of html under every prefix of host and path, the root included."""
    pages = _pages(spark, sf, F.length("html").cast("long").alias("chars"))
    out = hierarchy.rollup(pages, "path", pages=F.count("*"), chars=F.sum("chars"))
    return out.select(F.array_join("node", "/").alias("node"), F.size("node").cast("long").alias("depth"), "pages", "chars")


def subtree_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of one host, at most one segment below it."""
    pages = _pages(spark, sf).withColumn("path", F.concat(F.reverse(F.split(F.get("path", F.lit(0)), r"\.")), F.slice("path", 2, 100)))
    return hierarchy.subtree(pages, "path", ["com", "example"], 3).select("page_id", F.array_join("path", "/").alias("node"))


def deepest_ancestor(spark: SparkSession, sf: str) -> DataFrame:
    """The deepest node above each page that two pages or more lie in, and the segment after it."""
    pages = _pages(spark, sf)
    known = hierarchy.rollup(pages, "path", pages=F.count("*")).where("pages > 1 AND size(node) > 0").select(F.col("node").alias("path"))
    out = hierarchy.deepest_ancestor(pages, "path", known, ["page_id"])
    return out.select("page_id", F.array_join("found", "/").alias("found"), "symbol")


_RULES = [(["com"], False, ["a"]), (["com", "example"], False, ["b", "c"]), (["net", "example"], False, ["d"]), (["org"], True, ["e"]), ([], False, ["rest"])]


def longest_prefix_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Reversed hosts rewritten by the longest rule that fits."""
    rules = spark.createDataFrame(_RULES, "prefix array<string>, exact boolean, target array<string>")
    pages = _pages(spark, sf).select("page_id", F.reverse(F.split(F.get("path", F.lit(0)), r"\.")).alias("path"))
    out = hierarchy.longest_rule(pages, "path", F.broadcast(rules), ["page_id"])
    return out.select("page_id", F.array_join("rule.prefix", ".").alias("rule"), F.array_join("expanded", ".").alias("expanded"))


def suffix_find(spark: SparkSession, sf: str) -> DataFrame:
    """Parts whose path [type, brand, name] ends with a brand and the name of one part."""
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.array("p_type", "p_name", "p_brand").alias("path"))
    return hierarchy.by_suffix(parts, "path", ["Brand#13"]).select("p_partkey", F.array_join("path", "|").alias("node"))


def component_order(spark: SparkSession, sf: str) -> DataFrame:
    """Url paths in order of their segments, with their rank among distinct paths."""
    urls = spark.read.parquet(f"{sf}/pages.parquet").select(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", "").alias("url"))
    distinct = order.path_order(urls.distinct(), "url")
    # the rank is a running count over ranges of the order, so no task sorts all rows
    ranged = distinct.repartitionByRange("parts", "url").sortWithinPartitions("parts", "url").withColumn("__id", F.monotonically_increasing_id())
    ranged = materialize(ranged.select("url", F.shiftright("__id", 33).alias("part"), F.col("__id").bitwiseAND((1 << 33) - 1).alias("at")), "ranged")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.join(before, "part").select("url", (F.col("before") + F.col("at") + 1).alias("nth"))


def link_check(spark: SparkSession, sf: str) -> DataFrame:
    """Links of pages: external, ok if a page has that path, else broken; counted by state."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    hrefs = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    links = hrefs.select(F.col("href").rlike("^[a-z]+://").alias("external"), F.regexp_replace("href", "[?#].*$", "").alias("target"))
    known = pages.select(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]*", "").alias("target"))
    return documents.link_states(links, known, "target", "external").groupBy("state").agg(F.count("*").alias("links"), F.count_distinct("target").alias("targets"))


def pattern_capture(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as calls, insert::<brand>() or reg::load(container), and what the patterns `insert::<Brand#$T>` and `load` take from them, counted."""
    call = F.col("p_partkey") % 3 != 0
    parts = spark.read.parquet(f"{sf}/part.parquet").select(
        F.when(call, "insert").alias("method"), F.when(call, F.col("p_brand")).alias("generics"), F.when(call, "insert").otherwise("reg::load").alias("callee"), F.array("p_type").alias("args")
    )
    found = parts.select(code.captured("insert :: <Brand#$T>").alias("brand"), code.captured("load").alias("container"))
    return found.groupBy("brand", "container").agg(F.count("*").alias("parts"))


PATH = "list_filter(string_split(regexp_replace(regexp_replace(coalesce(url, ''), '[?#].*$', ''), '^[a-z]+://', ''), '/'), lambda x: x <> '')"
_P = f"p AS (SELECT page_id, {PATH} AS m, length(html) AS chars FROM pages)"
_PREFIXES = "list_transform(range(0, len(m) + 1), lambda i: m[1:i])"

QUERIES = {
    "path_rollup": path_rollup,
    "subtree_scan": subtree_scan,
    "deepest_ancestor": deepest_ancestor,
    "longest_prefix_rule": longest_prefix_rule,
    "suffix_find": suffix_find,
    "component_order": component_order,
    "link_check": link_check,
    "pattern_capture": pattern_capture,
}
ORACLES = {
    "path_rollup": f"""
WITH {_P}, n AS (SELECT unnest({_PREFIXES}) AS node, chars FROM p)
SELECT array_to_string(n.node, '/') AS node, CAST(len(n.node) AS BIGINT) AS depth, count(*) AS pages, CAST(sum(chars) AS BIGINT) AS chars FROM n GROUP BY n.node""",
    "subtree_scan": f"""
WITH {_P}, r AS (SELECT page_id, list_concat(list_reverse(string_split(m[1], '.')), m[2:]) AS m FROM p)
SELECT page_id, array_to_string(m, '/') AS node FROM r WHERE m[1:2] = ['com', 'example'] AND len(m) <= 5""",
    "deepest_ancestor": f"""
WITH {_P}, x AS (SELECT page_id, m, unnest({_PREFIXES}) AS pre FROM p), k AS (SELECT pre AS k FROM x WHERE len(pre) > 0 GROUP BY pre HAVING count(*) > 1),
b AS (SELECT page_id, max(len(pre)) AS n FROM x WHERE pre IN (SELECT k FROM k) GROUP BY page_id)
SELECT p.page_id, array_to_string(m[1:n], '/') AS found, m[n + 1] AS symbol FROM p LEFT JOIN b USING (page_id)""",
    "longest_prefix_rule": f"""
WITH {_P}, q AS (SELECT page_id, list_reverse(string_split(m[1], '.')) AS m FROM p),
rules(prefix, exact, target) AS (VALUES (['com'], false, ['a']), (['com', 'example'], false, ['b', 'c']), (['net', 'example'], false, ['d']), (['org'], true, ['e']), (CAST([] AS VARCHAR[]), false, ['rest'])),
f AS (SELECT page_id, m, prefix, exact, target, row_number() OVER (PARTITION BY page_id ORDER BY len(prefix) DESC, prefix) AS k FROM q JOIN rules ON (exact AND prefix = m) OR (NOT exact AND m[1:len(prefix)] = prefix))
SELECT q.page_id, array_to_string(prefix, '.') AS rule, array_to_string(CASE WHEN exact THEN target ELSE list_concat(target, f.m[len(prefix) + 1:]) END, '.') AS expanded FROM q LEFT JOIN f ON f.page_id = q.page_id AND k = 1""",
    "suffix_find": "SELECT p_partkey, p_type || '|' || p_name || '|' || p_brand AS node FROM part WHERE p_brand = 'Brand#13'",
    "component_order": """
WITH u AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') AS url FROM pages)
SELECT url, row_number() OVER (ORDER BY list_filter(string_split(url, '/'), lambda x: x <> ''), url) AS nth FROM u""",
    "link_check": """
WITH h AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
l AS (SELECT regexp_matches(href, '^[a-z]+://') AS external, regexp_replace(href, '[?#].*$', '') AS target FROM h),
k AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '') AS target FROM pages),
s AS (SELECT l.target, CASE WHEN external THEN 'external' WHEN k.target IS NOT NULL THEN 'ok' ELSE 'broken' END AS state FROM l LEFT JOIN k ON k.target = l.target)
SELECT state, count(*) AS links, count(DISTINCT target) AS targets FROM s GROUP BY state""",
    "pattern_capture": """
SELECT CASE WHEN p_partkey % 3 <> 0 THEN regexp_extract(p_brand, '^Brand#(.*)$', 1) END AS brand, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS container, count(*) AS parts FROM part GROUP BY 1, 2""",
}
