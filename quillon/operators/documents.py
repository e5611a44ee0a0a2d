"""Sections, links and coverage of documentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions import docs


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos (from 0), line."""
    return rows.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def sections(numbered: DataFrame, key: str) -> DataFrame:
    """lines() -> key, pos, level, title, stop, n_lines of every heading outside code fences. A section runs to the next heading of its level or above,
    so sections hold those below them. stop is the position after its last line.

    The next such heading is found among six running minima, one for each level, in one window for each document.
    """
    w = W.partitionBy(key).orderBy("pos")
    fence = F.col("line").rlike(r"^\s*```")
    fenced = numbered.withColumn("fences", F.sum(F.when(fence, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    level = F.when((F.col("fences") % 2 == 0) & ~fence, docs.heading_level("line")).otherwise(0)
    marked = fenced.withColumn("level", level)
    later = w.rowsBetween(1, W.unboundedFollowing)
    ends = [F.min(F.when(F.col("level").between(1, n), F.col("pos"))).over(later) for n in range(1, 7)]
    total = F.max("pos").over(W.partitionBy(key)) + 1
    stop = F.coalesce(F.element_at(F.array(*ends), F.greatest("level", F.lit(1))), total)
    found = marked.withColumn("stop", stop).where("level > 0")
    return found.select(key, "pos", "level", F.trim(F.regexp_replace("line", "^#{1,6} ", "")).alias("title"), "stop", (F.col("stop") - F.col("pos") - 1).alias("n_lines"))


def coverage(items: DataFrame, documented: DataFrame, key: str, by: str) -> DataFrame:
    """by, documented, total and percent (rounded down) of items whose key is in documented."""
    flagged = items.join(documented.select(key).distinct().withColumn("__has", F.lit(1)), key, "left")
    out = flagged.groupBy(by).agg(F.count("__has").alias("documented"), F.count("*").alias("total"))
    return out.withColumn("percent", F.floor(F.col("documented") * 100 / F.col("total")))


def missing(items: DataFrame, documented: DataFrame, key: str) -> DataFrame:
    return items.join(documented.select(key), key, "left_anti")


def link_states(links: DataFrame, known: DataFrame, target: str, external: str) -> DataFrame:
    """links with state: external (where the column external is true), ok if known has the target, else broken."""
    joined = links.join(known.select(target).distinct().withColumn("__ok", F.lit(True)), target, "left")
    return joined.withColumn("state", F.when(F.col(external), "external").when(F.col("__ok"), "ok").otherwise("broken")).drop("__ok")
