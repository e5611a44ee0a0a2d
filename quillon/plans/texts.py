"""Queries over the text of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import docs
from quillon.operators import documents


def _documents(spark: SparkSession, sf: str, *columns) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select(*columns)


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of documents of each source that have a label."""
    return documents.coverage(_documents(spark, sf, "doc_id", "source"), spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "source")


def missing_list(spark: SparkSession, sf: str) -> DataFrame:
    return documents.missing(_documents(spark, sf, "doc_id", "lang"), spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")


def doc_summary(spark: SparkSession, sf: str) -> DataFrame:
    """First sentence of the first paragraph."""
    return _documents(spark, sf, "doc_id", docs.summary("text").alias("summary"))


def doc_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of documents. A first line counts as a heading of level 1; a line of one word is one of level 2, of two words of level 3."""
    numbered = documents.lines(_documents(spark, sf, "doc_id", "text"), "doc_id", "text")
    words = F.size(F.filter(F.split("line", " "), lambda x: x != ""))
    marks = F.when(F.col("pos") == 0, "# ").when(words == 1, "## ").when(words == 2, "### ").otherwise("")
    return documents.sections(numbered.withColumn("line", F.concat(marks, "line")), "doc_id").select("doc_id", "pos", "level", F.md5("title").alias("title_md5"), "stop", "n_lines")


def topic_search(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items that are, or contain all words of, `the of and`; if an item is exactly that, only such items."""
    found = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", docs.matches_topic("text", "the of and").alias("match")).where("match > 0")
    best = found.agg(F.max("match").alias("match"))
    return found.join(F.broadcast(best), "match").select("item_id", "match")


_W = "list_filter(string_split(line, ' '), lambda x: x <> '')"
QUERIES = {"coverage": coverage, "missing_list": missing_list, "doc_summary": doc_summary, "doc_sections": doc_sections, "topic_search": topic_search}
ORACLES = {
    "coverage": """SELECT source, count(l.doc_id) AS documented, count(*) AS total, CAST(floor(count(l.doc_id) * 100.0 / count(*)) AS BIGINT) AS percent
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY source""",
    "missing_list": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "doc_summary": r"""
WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '^\s+', ''), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: regexp_matches(x, '^\s*$|^#{1,6} ')), true) AS stop FROM t),
q AS (SELECT doc_id, trim(regexp_replace(array_to_string(CASE WHEN stop > 0 THEN ls[1:stop - 1] ELSE ls END, ' '), '\s+', ' ', 'g')) AS p FROM p),
r AS (SELECT doc_id, p, replace(replace(p, 'e.g.', 'e.g' || chr(1)), 'i.e.', 'i.e' || chr(1)) AS h FROM q)
SELECT doc_id, nullif(coalesce(nullif(replace(regexp_extract(h, '^(.*?[.])(?: |$)', 1), chr(1), '.'), ''), p), '') AS summary FROM r""",
    "doc_sections": f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
h AS (SELECT doc_id, pos, line, count(*) OVER (PARTITION BY doc_id) AS total, CASE WHEN pos = 0 THEN 1 WHEN len({_W}) = 1 THEN 2 WHEN len({_W}) = 2 THEN 3 ELSE 0 END AS level FROM l),
s AS (SELECT *, min(CASE WHEN level BETWEEN 1 AND 1 THEN pos END) OVER w AS e1, min(CASE WHEN level BETWEEN 1 AND 2 THEN pos END) OVER w AS e2, min(CASE WHEN level BETWEEN 1 AND 3 THEN pos END) OVER w AS e3
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, level, md5(trim(line)) AS title_md5, CAST(coalesce(CASE level WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END, total) AS INTEGER) AS stop,
  CAST(coalesce(CASE level WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END, total) - pos - 1 AS INTEGER) AS n_lines FROM s WHERE level > 0""",
    "topic_search": """
WITH m AS (SELECT item_id, CASE WHEN lower(text) = 'the of and' THEN 2 WHEN contains(lower(text), 'the') AND contains(lower(text), 'of') AND contains(lower(text), 'and') THEN 1 ELSE 0 END AS match FROM benchmark)
SELECT item_id, match FROM m WHERE match > 0 AND match = (SELECT max(match) FROM m)""",
}
