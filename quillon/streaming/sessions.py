"""Session transcripts as a stream: the uses of every tool, counted by day as sessions grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.transcripts import uses


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """session, at (null: a stream gives lines no number), ts, record of every readable line of the files folder/*.jsonl, as they come."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]*)\.jsonl$", 1)
    lines = spark.readStream.format("text").option("pathGlobFilter", "*.jsonl").load(folder)
    rows = lines.select(name.alias("session"), F.lit(None).cast("long").alias("at"), F.try_parse_json("value").alias("record")).where("record IS NOT NULL")
    return rows.withColumn("ts", F.try_to_timestamp(F.try_variant_get("record", "$.timestamp", "string")))


def tool_counts(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """day, session, tool, uses. A day is final, and its state given up, once lines are `late` behind it; lines without a time are left out."""
    timed = lines.where("ts IS NOT NULL").withWatermark("ts", late).withColumn("day", F.window("ts", "1 day"))
    days = timed.select(F.struct("session", "day").alias("session"), "at", "record")  # uses() hands its session on as it is
    found = uses(days).groupBy("session.day", "session.session", "tool").agg(F.count("*").alias("uses"))
    return found.select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "session", "tool", "uses")
