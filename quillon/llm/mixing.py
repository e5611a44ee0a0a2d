"""Mixing sources to target weights under a time-varying curriculum. DataFrame operations only.

A source's weight is a piecewise-linear schedule over training time 0 to 1; its integral is the source's share. Targets are filled like water:
no source gives more than `most` times its words, and what it cannot give is shared by weight among the others. Within a source, documents stand
in the order of a digest of their ids; a document's place among the words that are demanded of its source is turned into a training position by
inverting the integral of the schedule. Running sums are taken in 4,096 slices of a source first, so that a source with a third of all rows is
spread over all tasks. A source that is taken several times is passed over in the same order again, and every pass has positions of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.runtime import bounded, materialize

#: By weight class: (time, weight) knots; integrals 1, 2 and 3. The first fades, the second is even, the third grows.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 1.5), (1.0, 4.5)))
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def segments(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float, float]]:
    """(start, length, weight at the start, weight at the end, integral before, integral after) of each piece of a schedule."""
    out, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (w0 + w1) / 2 * (t1 - t0)
        out.append((t0, t1 - t0, w0, w1, total, total + area))
        total += area
    return out


def _pieces(schedules) -> tuple[Column, Column]:
    """(pieces, integral) of the schedule of a row's weight class, as literals."""

    def literal(k: int) -> Column:
        return F.array(*(F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(s, ("t", "h", "w0", "w1", "c0", "c1")))) for s in segments(schedules[k])))

    kinds = range(len(schedules))
    pieces = F.element_at(F.array(*(literal(k) for k in kinds)), F.col("kind") + 1)
    total = F.element_at(F.array(*(F.lit(float(segments(schedules[k])[-1][5])) for k in kinds)), F.col("kind") + 1)
    return pieces, total


def targets(sources: DataFrame, schedules=SCHEDULES, most: int = 3) -> DataFrame:
    """sources: source, source_size -> with kind, weight, target. One row for each source, so windows without a key hold no documents."""
    ranked = sources.withColumn("nth", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("kind", ((F.col("nth") - 1) % len(schedules)).cast("int"))
    weighed = ranked.withColumn("weight", _pieces(schedules)[1]).withColumn("cap", F.col("source_size") * most)
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    level = (F.sum("source_size").over(W.partitionBy()) - before).cast("double") / rest
    leveled = weighed.withColumn("level", level).withColumn("level", F.max("level").over(W.partitionBy()))
    return leveled.select("source", "source_size", "kind", "weight", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def position(share: Column, pieces: Column, total: Column) -> Column:
    """The time at which a schedule has spent `share` (0 to 1) of its integral."""
    spent = share * total
    p = F.get(F.filter(pieces, lambda s: s["c1"] >= spent), F.lit(0))
    a, c = (p["w1"] - p["w0"]) / (p["h"] * 2), p["c0"] - spent
    root = p["w0"] + F.sqrt(F.greatest(p["w0"] * p["w0"] - a * c * 4, F.lit(0.0)))
    return F.when(p.isNull(), F.lit(1.0)).otherwise(p["t"] + F.when(root > 0, c * -2 / root).otherwise(F.lit(0.0)))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, schedules, most: int, also: tuple[str, ...] = ()) -> DataFrame:
    """For every row: doc_id, source, size, source_size, target, taken, and at (words of the source before it), goal, passes, part, kind; columns in also."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *also)
    sized = materialize(sized.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("slice", F.substring("key", 1, 3)), "sized")
    sliced = sized.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sliced = materialize(sliced.select("source", "slice", "words", before.alias("before")), "slices")
    goals = materialize(targets(sliced.groupBy("source").agg(F.sum("words").alias("source_size")), schedules, most), "targets")
    offsets = materialize(sliced.join(bounded(goals.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s", "words"), "offsets")

    inner = F.coalesce(F.sum("size").over(W.partitionBy("source", "slice").orderBy("key", "doc_id", "size", *also).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("inner", inner)
    o = offsets.withColumnsRenamed({"source": "s", "slice": "c"})
    placed = placed.join(o, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("c")))
    at, goal = F.col("before") + F.col("inner"), F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    placed = placed.withColumns({"at": at, "goal": goal}).withColumn("passes", passes)
    part = F.greatest(F.lit(0), F.least("size", F.col("goal") - F.col("passes") * F.col("source_size") - F.col("at")))
    return placed.withColumn("part", part).withColumn("taken", F.col("passes") * F.col("size") + F.col("part"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules=SCHEDULES, most: int = 3) -> DataFrame:
    r"""For every row, ordered by position: doc_id, source, size, source_size, target, taken, position.

    size: number of [^\x20\x09-\x0D]+ in the text (null: 0). taken: words the mix takes, repeats counted; a source's add up to its target, rounded.
    position: training time of the middle of what is taken in the first pass over the source; null if nothing is taken. passes() has those of all
    passes. A null source is a source, the last. Rows without words take nothing; sources without words have target 0. Null ids and repeated rows are
    rows like others.
    """
    placed = _placed(docs, id_col, text_col, source_col, schedules, most)
    first = F.when(F.col("passes") > 0, F.col("size")).otherwise(F.col("taken"))
    pieces, total = _pieces(schedules)
    when = F.when(F.col("taken") > 0, position((F.col("at") + first / 2) / F.col("goal"), pieces, total))
    out = placed.select("doc_id", "source", "size", "source_size", "target", "taken", F.round(when, 6).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def passes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules=SCHEDULES, most: int = 3, also: tuple[str, ...] = ()) -> DataFrame:
    """For every row and every pass that takes words of it: doc_id, source, copy (1 for the first pass), size, words (taken in that pass), position.

    position: training time of the middle of what that pass takes, not rounded. also: further columns of docs, whose values break ties of equal rows.
    """
    placed = _placed(docs, id_col, text_col, source_col, schedules, most, also).where("taken > 0")
    last = F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), last)))
    each = each.withColumn("words", F.when(F.col("copy") <= F.col("passes"), F.col("size")).otherwise(F.col("part")))
    pieces, total = _pieces(schedules)
    middle = (F.col("at") + (F.col("copy") - 1) * F.col("source_size") + F.col("words") / 2) / F.col("goal")
    return each.select("doc_id", "source", F.col("copy").cast("int").alias("copy"), "size", "words", position(middle, pieces, total).alias("position"), *also)


def mixed(docs: DataFrame, copy_col: str | None = None, position_col: str | None = None) -> DataFrame:
    """docs (doc_id, text, source and others) as the mix takes them, in the order of training: rows once for each pass that takes half of them or more.

    copy_col, position_col: names of columns to add, with the number of the pass and the training position. A column of that name is replaced.
    """
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    plan = passes(rows, also=("__row",)).where("words * 2 >= size").select("__row", F.col("copy").alias("__copy"), F.col("position").alias("__position"))
    joined = rows.join(bounded(materialize(plan, "passes")), "__row").orderBy("__position", "__row", "__copy")
    added = {name: F.col(c) for name, c in ((copy_col, "__copy"), (position_col, "__position")) if name}
    return joined.withColumns(added).select(*(c for c in docs.columns if c not in added), *added)


def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(w) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev FROM r),
t AS (SELECT source, source_size, w, least(CAST(3 * source_size AS DOUBLE), (SELECT max(lev) FROM l) * w) AS target FROM l),
p AS (SELECT doc_id, d.source, size, source_size, w, target, CAST(round(target) AS BIGINT) AS goal,
  CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM p),
u AS (SELECT *, passes * size + greatest(0, least(size, goal - passes * source_size - before)) AS taken FROM q),
v AS (SELECT *, (before + CAST(CASE WHEN passes > 0 THEN size ELSE taken END AS DOUBLE) / 2) / goal * w AS spent,
  CASE w WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END AS b, CASE w WHEN 1 THEN -0.5::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE 1.5::DOUBLE END AS a FROM u)
SELECT doc_id, source, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN round(2 * spent / (b + sqrt(greatest(b * b + 4 * a * spent, 0.0))), 6) END AS position FROM v"""
