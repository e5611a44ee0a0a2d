"""Rows told apart by what they hold: ids may be null or repeated, and a number for each row would need a copy of all texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import bounded, materialize


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", doc: str = "doc", tag: str = "tag") -> DataFrame:
    """docs with two numbers that name id and text of a row: the id (without one, a hash of the text) and another hash of the text."""
    key = F.col(id_col).cast("long")
    return docs.withColumns({tag: F.xxhash64(text_col), doc: F.coalesce(key, F.xxhash64(F.lit("no id"), text_col))})


def staying(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that do not stay; columns as they were. verdicts: doc, tag and stays; rows without a verdict stay. Of rows that are equal in
    id and text all stay, or none, or one (any of them)."""
    sums = verdicts.groupBy("doc", "tag").agg(F.count("*").alias("n"), F.count_if("stays").alias("k")).where("k < n")
    sums = materialize(sums.select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), (F.col("k") > 0).alias("one")), "gone")
    named = keyed(docs, id_col, text_col, "__doc", "__tag")
    out = named.join(bounded(sums.drop("one")), ["__doc", "__tag"], "left_anti")
    some = sums.where("one").drop("one")
    if not some.isEmpty():
        out = out.unionByName(named.join(bounded(some), ["__doc", "__tag"], "left_semi").dropDuplicates(["__doc", "__tag"]))
    return out.select(*docs.columns)
