"""Prediction and gold files, paired line by line, to scores; and text files through a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import strip
from ..operators.metrics.classification import classification_report
from ..operators.metrics.dependency import align_dependencies, attachment_scores, dependency_lines
from ..operators.metrics.overlap import chrf_score, chrf_statistics, chrf_sums
from ..operators.metrics.tagging import entity_counts, entity_scores, entity_sums, iob_line
from ..operators.prediction import ModelLoader, align, batch_generate
from ..sources.lines import dense_index, read_lines_indexed, read_prediction_records, write_lines
from .evaluate import evaluate_reading, long_rows


def paired_lines(spark: SparkSession, pred_path, gold_path) -> DataFrame:
    """`row_id, pred, gold` of two files with equally many lines; a missing line fails the job."""
    def side(path, name: str) -> DataFrame:
        return read_lines_indexed(spark, path).select("row_id", strip(F.col("value")).alias(name))

    return align(side(pred_path, "pred"), side(gold_path, "gold"), strict=True)


def score_label_files(spark: SparkSession, pred_path, gold_path, compat: bool = False) -> DataFrame:
    """Classification report with the classes' first gold row, one label per line."""
    return classification_report(paired_lines(spark, pred_path, gold_path), order="row_id", compat=compat)


def score_tag_files(spark: SparkSession, pred_path, gold_path) -> DataFrame:
    """`metric, value` of tagged sentences: entity F1, word F1 of the mark sequences, chrF with beta 1, in one pass."""
    pred, gold = F.col("pred"), F.col("gold")
    counted = paired_lines(spark, pred_path, gold_path).select(
        entity_counts(pred, gold).alias("_entities"), chrf_statistics(iob_line(pred), iob_line(gold), 0, 1).alias("_marks"),
        chrf_statistics(pred, gold).alias("_text"))
    sums = counted.agg(*entity_sums("_entities"), *chrf_sums("_marks", 1, "_m"), *chrf_sums("_text", 6))
    scored = entity_scores(sums).select(F.col("f1").alias("entity_f1"), chrf_score(1, 1.0, "_m").alias("iob_word_f1"),
                                        chrf_score(6, 1.0).alias("chrf"))
    return long_rows(scored, ["entity_f1", "iob_word_f1", "chrf"])


def score_dependency_files(spark: SparkSession, pred_path, gold_path) -> DataFrame:
    """Attachment scores; only relation lines count, and the n-th one of each file belongs together."""
    def side(path, name: str) -> DataFrame:
        lines = dependency_lines(read_lines_indexed(spark, path)).select(F.col("row_id").alias("line"),
                                                                         F.col("value").alias(name))
        return dense_index(lines, "line").drop("line")

    return attachment_scores(align_dependencies(align(side(pred_path, "pred"), side(gold_path, "gold"), strict=True)))


def score_reading_file(spark: SparkSession, pred_path, golds: DataFrame, on_missing: str = "keep") -> DataFrame:
    """Reading-task scores of a prediction file against `row_id, golds`."""
    predictions = read_prediction_records(spark, pred_path)
    return evaluate_reading(align(predictions, golds, strict=True), on_missing=on_missing)


def generate_lines(spark: SparkSession, in_path, out_path: str, load: ModelLoader, batch_size: int = 32) -> None:
    """A text file, one input per line, to the model's output lines in the same order.

    The lines are sorted before the model runs: sorting afterwards would run the model a second time to sample keys.
    """
    lines = read_lines_indexed(spark, in_path).select("row_id", F.col("value").alias("input_text"))
    write_lines(batch_generate(lines.orderBy("row_id"), load, batch_size), out_path, "prediction")
