"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of documents; mixing adds copy and position. Not all stages can be put into SQL (a trained classifier, a
tokenizer), so ORACLE_SQL is None and tests/llm/test_pipeline.py compares run() with a brute-force version. Ids may be null or repeated, texts null,
empty or very long, and tables empty: every row is one of its own. Rows of equal texts are one after the second stage, whatever their ids; rows
without an id are linked with nothing in the third.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import exact, mixing, near, pieces, toxicity
from quillon.runtime import fresh_path, materialize, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one stays."""
    return exact.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by sets of five-word shingles with a similarity of 0.8 or more one stays."""
    return near.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, in the order of training: rows of sources that are to grow repeat, others go."""
    return mixing.mixed(docs, "copy", "position")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, copy, position, n_pieces and ids of what is left; copies of a document are segmented apart."""
    return pieces.with_ids(docs, copy_col="copy").selectExpr("doc_id", "source", "lang", "copy", "position", "size(ids) AS n_pieces", "ids")


STAGES = [("toxicity", drop_toxic), ("exact dedup", exact_dedup), ("minhash near-dedup", near_dedup), ("mixing", mix), ("sentencepiece", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way is deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        path = fresh_path(spark, f"stage-{k}")
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{k}", path)
