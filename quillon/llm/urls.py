"""URL filters: listed rules first, then association rules that FP-growth mines from labelled urls. DataFrame operations only.

A url's items are its domain suffixes, subdomain, path segments without numbers, file ending and query keys. Urls that a listed rule settles are
the labelled ones; their items and their label are one basket. Rules items -> label are kept above a confidence and a support, and only if no rule
with fewer of their items is as confident. An inverted index from item to rule finds the rules of the others: a rule fires when all its items are
hit. Matching is done once for each distinct set of items that occur in rules, so hosts with many pages cost no more than others.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.runtime import bounded, materialize

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
SUPPORT, CONFIDENCE = 0.005, 0.9
#: The verdict on a url that neither a listed nor a mined rule matches.
OTHERWISE = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or end, A-Z lower-cased. Path: then up to ? # or end. Null or no ://: both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def suffixes(host: Column) -> Column:
    """The host and its parent domains: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def items(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url; numbers are left out, so that urls of one pattern share their items."""
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & ~p.rlike(r"^[0-9]+(\.[a-z0-9]+)?$"))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda q: F.regexp_extract(q, r"^[^=]*", 0)), lambda q: q != "")
    all_items = F.concat(
        F.transform(F.filter(suffixes(host), lambda s: s != ""), lambda s: F.concat(F.lit("domain:"), s)),
        F.when(F.size(labels) > 3, F.array(F.concat(F.lit("sub:"), labels[0]))).otherwise(F.array().cast("array<string>")),
        F.transform(parts, lambda p: F.concat(F.lit("path:"), p)),
        F.when(ending != "", F.array(F.concat(F.lit("ending:"), ending))).otherwise(F.array().cast("array<string>")),
        F.transform(keys, lambda k: F.concat(F.lit("key:"), k)),
    )
    return F.array_sort(F.array_distinct(all_items))


def listed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (host, path, ...) with rule and listed: the longest of rules (verdict, host, path) that fits host or a parent domain and starts the path.

    Rules are gathered for each distinct host, so pages meet them in one join on host.
    """
    own = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "verdict").distinct()
    hosts = pages.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("suffix"))
    rule = F.concat("suffix", "start")
    fits = hosts.join(bounded(own), "suffix").groupBy(F.col("host").alias("__host")).agg(F.collect_set(F.struct(F.length(rule).alias("n"), rule.alias("rule"), "start", "verdict")).alias("__fits"))
    fits = bounded(materialize(fits, "fits"))  # written first: a join on top of an aggregate cannot be split where a host has very many pages
    best = F.array_max(F.filter("__fits", lambda r: F.startswith(F.col("path"), r["start"])))
    joined = pages.join(fits, pages.host == fits["__host"], "left").withColumn("__best", best)
    return joined.withColumns({"rule": F.col("__best.rule"), "listed": F.col("__best.verdict")}).drop("__host", "__fits", "__best")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """labelled (items, label) -> rules: items, label, confidence, support. At most mean basket size / support items are frequent."""
    spark = labelled.sparkSession
    label = F.concat(F.lit("label="), "label")
    baskets = materialize(labelled.where("label IS NOT NULL").select(F.concat("items", F.array(label)).alias("items")), "baskets")
    schema = "items array<string>, label string, confidence double, support double"
    if baskets.isEmpty():
        return spark.createDataFrame([], schema)
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(baskets).associationRules
    mined = found.where(F.startswith(F.col("consequent")[0], F.lit("label="))).where(~F.exists("antecedent", lambda a: F.startswith(a, F.lit("label="))))
    mined = materialize(mined.select(F.array_sort("antecedent").alias("items"), F.regexp_replace(F.col("consequent")[0], "^label=", "").alias("label"), "confidence", "support"), "rules")
    # a rule goes if one with one item less says the same with no less confidence
    less = mined.select("label", F.col("confidence").alias("c"), F.explode(F.transform("items", lambda i: F.array_remove(F.col("items"), i))).alias("shorter"), "items")
    beaten = less.join(mined.select("label", F.col("items").alias("shorter"), F.col("confidence").alias("d")), ["label", "shorter"]).where("d >= c").select("label", "items").distinct()
    return mined.join(beaten, ["label", "items"], "left_anti").select("items", "label", "confidence", "support")


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (items, ...) with mined: the label of the best rule whose items the page has (confidence, support, fewest items, then by name)."""
    rules = materialize(rules.withColumn("rule", F.array_join("items", "\n")).withColumn("n", F.size("items")), "rules")
    index = rules.select(F.explode("items").alias("item"), "rule", "label", "n", "confidence", "support")
    sets = pages.select("items").distinct()
    # only items that are in rules count; this makes most sets alike
    known = sets.select("items", F.explode("items").alias("item")).join(bounded(index.select("item").distinct()), "item").groupBy("items").agg(F.array_sort(F.collect_set("item")).alias("hit"))
    known = materialize(known, "known")
    alike = known.select("hit").distinct().select("hit", F.explode("hit").alias("item"))
    fired = alike.join(bounded(index), "item").groupBy("hit", "rule", "label", "n", "confidence", "support").agg(F.count("*").alias("got")).where("got = n")
    best = fired.groupBy("hit").agg(F.max_by("label", F.struct("confidence", "support", -F.col("n"), "rule", "label")).alias("mined"))
    by_set = materialize(known.join(best, "hit").select("items", "mined"), "best")
    return pages.join(by_set, "items", "left")


def measured(pages: DataFrame, rules: DataFrame, url_col: str = "url", support: float = SUPPORT, confidence: float = CONFIDENCE, fold: int = 0, folds: int = 5) -> DataFrame:
    """How mined rules do on urls they were not mined from: of the hosts whose crc32 mod `folds` is `fold`, the urls that a listed rule settles.

    One row: n (such urls), settled (a mined rule matches), right (with the listed rule's label), blocked (the listed rule blocks), found (and a mined
    rule does too). Whole hosts are held out, so no url is judged by its own neighbours.
    """
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    judged = listed(split.withColumn("items", items(F.col("url"), F.col("host"), F.col("path"))).drop("url"), rules).where("listed IS NOT NULL")
    judged = materialize(judged.withColumn("held", F.crc32(F.col("host").cast("binary")) % folds == fold), "judged")
    out = matched(judged.where("held"), mine(judged.where("NOT held").select("items", F.col("listed").alias("label")), support, confidence))
    same, block = F.col("mined") == F.col("listed"), F.col("listed") == "block"
    return out.agg(F.count("*").alias("n"), F.count("mined").alias("settled"), F.count_if(same).alias("right"), F.count_if(block).alias("blocked"), F.count_if(same & block).alias("found"))


def filtered(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """For every row: page_id, host, path, rule, verdict, mined. rules: verdict, host, path.

    Null urls and urls without :// have an empty host and path, match no listed rule, and get the mined or the default verdict. rule is null
    where no listed rule matches. Null ids and repeated rows are rows like others; other columns are ignored.
    """
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    judged = listed(split.withColumn("items", items(F.col("url"), F.col("host"), F.col("path"))).drop("url"), rules)
    judged = materialize(judged, "listed")
    out = matched(judged, mine(judged.select("items", F.col("listed").alias("label")), support, confidence))
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", "mined", F.lit(OTHERWISE)).alias("verdict"), "mined")


def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filtered(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url"), rules)
