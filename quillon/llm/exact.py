"""Exact dedup by a tree-merge of sorted digest runs.

Each partition sorts its digests into a run in which every digest stands once, with the best row and the number of rows. Runs are cut into
segments by digest, and in each round a fixed number of neighbouring runs of a segment are merged into one, until each segment has one run:
the rounds of a binomial tree. Copies meet as early as possible, so a digest that a third of all rows have is one record in each run, and no
task holds more than `fan` runs of one segment.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.rows import keyed, staying
from quillon.runtime import materialize, ship

#: [\x20\x09-\x0D]
BLANK = " \t\n\x0b\x0c\r"
RUN = "segment int, parent long, run long, digest binary, n_bytes long, proof long, n_chars long, keep_id long, keep_row long, group_size long"
_ARROW = pa.schema([("segment", pa.int32()), ("parent", pa.int64()), ("run", pa.int64()), ("digest", pa.binary()), ("n_bytes", pa.int64()), ("proof", pa.int64()), ("n_chars", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])
_KEY = slice(3, 6)
#: Rows of a segment in all runs together: what a merge holds is bounded by it.
SEGMENT_ROWS = 100_000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANK, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """For each row: row (a number, lasting once this is written), id, number of code points, and digest, byte length and second hash of the text
    without white space; columns in also."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *also, F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"), normalised(F.col(text_col)).alias("norm"))
    return rows.select("row", "doc_id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.octet_length("norm").cast("long").alias("n_bytes"), F.xxhash64("norm").alias("proof"), "n_chars", *also)


def _best(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of rows sorted by digest, one for each: most code points, then smallest id (null last), then first row. Equal digests of unlike texts stay apart."""
    for _, same in groupby(rows, key=lambda r: r[_KEY]):
        best = next(same)
        size = best[9]
        for r in same:
            size += r[9]
            if (-r[6], r[7] is None, r[7] or 0, r[8]) < (-best[6], best[7] is None, best[7] or 0, best[8]):
                best = r
        yield (*best[:9], size)


def _tuples(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(_ARROW), _ARROW.types)], schema=_ARROW)


def _batches(rows: Iterator[tuple], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, most)):
        yield _batch(part)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first level: the sorted rows of one partition become a run."""
    yield from _batches(_best(r for b in batches for r in _tuples(b)))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come by segment, parent, run and digest: the child runs of a parent, one after the other, are merged as the sorted runs that they are."""
    for _, family in groupby((r for b in batches for r in _tuples(b)), key=lambda r: r[:2]):
        children = [list(run) for _, run in groupby(family, key=lambda r: r[2])]
        yield from _batches(_best(heapq.merge(*children, key=lambda r: r[_KEY])))


def winners(found: DataFrame, fan: int = 8, segments: int | None = None) -> DataFrame:
    """One row for each digest of digests(): keep_id, keep_row, group_size.

    fan: runs that one merge takes. segments: ranges of digests, by default so many that each has SEGMENT_ROWS distinct rows at most, by the rows that
    the runs were counted to have; a merge holds one segment of `fan` runs.
    """
    ship(found.sparkSession)
    part = F.spark_partition_id().cast("long")
    rows = found.select(F.lit(0).alias("segment"), part.alias("parent"), part.alias("run"), "digest", "n_bytes", "proof", "n_chars", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    runs = materialize(rows.sortWithinPartitions("digest", "n_bytes", "proof").mapInArrow(_combine, RUN), "runs")
    counted = runs.agg(F.count("*").alias("n"), F.max("run").alias("last")).first()
    segments, left = segments or -(-counted.n // SEGMENT_ROWS) or 1, (counted.last or 0) + 1
    cut = F.floor(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") * segments / F.lit(2**32)).cast("int")
    runs = runs.withColumn("segment", cut)
    while left > 1:
        dealt = runs.withColumn("parent", F.floor(F.col("run") / fan).cast("long")).repartition("segment", "parent")
        merged = dealt.sortWithinPartitions("segment", "parent", "run", "digest", "n_bytes", "proof").mapInArrow(_merge, RUN)
        runs, left = merged.withColumn("run", F.col("parent")), -(-left // fan)
    return runs.select("digest", "n_bytes", "proof", "keep_id", "keep_row", "group_size")


def _judged(found: DataFrame, fan: int = 8, segments: int | None = None) -> DataFrame:
    return found.drop("n_chars").join(winners(found, fan, segments), ["digest", "n_bytes", "proof"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = 8, segments: int | None = None) -> DataFrame:
    r"""For every row: doc_id, keep_id, group_size, kept, text_sha256. Texts are equal when identical without [\x20\x09-\x0D].

    Null text counts as empty; empty texts are copies of each other. One row of each group is kept: a null id only if no copy has an id, and of rows
    that repeat an id and a text the first. Other columns of docs are ignored.
    """
    out = _judged(materialize(digests(docs, id_col, text_col), "digests"), fan, segments)
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts; columns as they were. Ids may be null or repeated."""
    found = materialize(digests(keyed(docs.select(id_col, text_col), id_col, text_col), id_col, text_col, ("doc", "tag")), "digests")
    return staying(docs, _judged(found).select("doc", "tag", (F.col("row") == F.col("keep_row")).alias("stays")), id_col, text_col)


def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)"""
