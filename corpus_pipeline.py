"""Five stages from raw documents to token ids; each reads what its predecessor kept."""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textmill.llm import bpe, line_dedup, minhash, mixing, quality  # noqa: E402
from textmill.llm.common import free_name, stored, table  # noqa: E402


def _with(docs: DataFrame, decisions: DataFrame, how: str = "inner") -> DataFrame:
    """The documents that have a decision, under their id; `decisions` has one row for each id and its columns come last."""
    decided = free_name("_decided", [*docs.columns, *decisions.columns])
    decisions = decisions.withColumnRenamed("doc_id", decided)
    return docs.join(decisions, F.col("doc_id").eqNullSafe(F.col(decided)), how).drop(decided)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from all labels of the stage's own documents."""
    good = quality.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select("doc_id").distinct()
    return _with(docs, good, "left_semi").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of a smaller id holds; n_chars follows the text."""
    result = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        result = result.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return result.select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    kept = minhash.near_duplicates(docs).where("kept").select("doc_id").distinct()
    return _with(docs, kept, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: as many rows, or none."""
    times, copy = free_name("_repeats", docs.columns), free_name("_copy", docs.columns)
    repeats = mixing.mix(docs).groupBy("doc_id").agg(F.max("repeats").alias(times)).where(F.col(times) > 0)
    return _with(docs, repeats).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids."""
    encoded = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality_classifier", classify_quality), ("line_dedup", dedup_lines), ("near_dedup", dedup_near),
          ("mix_sources", mix_sources), ("byte_bpe", encode)]

#: The classifier, the signatures and the token ids have no SQL; tests hold the stages against plain computations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; between two stages the rows are a written table."""
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
