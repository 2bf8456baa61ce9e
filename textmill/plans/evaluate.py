"""Prediction files or tables to task metrics, each in one aggregation over the aligned rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import normalize_question_answer
from ..operators.labels import apply_correction, lookup_label_id
from ..operators.metrics.answers import score_reading_answers, score_squad_answers
from ..operators.metrics.classification import accuracy
from ..operators.metrics.overlap import chrf_score, chrf_statistics, chrf_sums, with_rouge
from ..operators.prediction import parse_reading_prediction
from .tasks import get_task

_ROUGE = ("rouge1", "rouge2", "rougeL", "rougeLsum")


def long_rows(row: DataFrame, columns: list[str]) -> DataFrame:
    """One wide row to `metric, value` rows."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]
    return row.select(F.inline(F.array(*pairs)))


def evaluate_reading(df: DataFrame, prediction: str = "prediction", golds: str = "golds",
                     on_missing: str = "unknown", tokenizer: str = "ascii") -> DataFrame:
    """Parsed predictions against gold answer lists: official EM and run F, SQuAD EM and F1, ROUGE."""
    parsed = df.select(parse_reading_prediction(F.col(prediction), on_missing).alias("prediction"),
                       F.col(golds).alias("golds"))
    scored = with_rouge(score_squad_answers(score_reading_answers(parsed)), "prediction", "golds", tokenizer)
    wide = scored.agg(F.avg("em").alias("exact_match"), F.avg("rouge_w").alias("rouge_w"),
                      (F.avg("squad_em") * 100).alias("squad_exact_match"),
                      (F.avg("squad_f1") * 100).alias("squad_f1"),
                      *[F.avg(n).alias(n) for n in _ROUGE])
    return long_rows(wide, ["exact_match", "rouge_w", "squad_exact_match", "squad_f1", *_ROUGE])


def normalized_questions(df: DataFrame, prediction: str = "prediction", golds: str = "golds") -> DataFrame:
    return df.withColumns({prediction: normalize_question_answer(F.col(prediction)),
                           golds: F.transform(golds, normalize_question_answer)})


def evaluate_questions(df: DataFrame, prediction: str = "prediction", golds: str = "golds") -> DataFrame:
    """Normalised predictions and answers: SQuAD EM and F1."""
    scored = score_squad_answers(normalized_questions(df, prediction, golds), prediction, golds)
    wide = scored.agg((F.avg("squad_em") * 100).alias("squad_exact_match"),
                      (F.avg("squad_f1") * 100).alias("squad_f1"))
    return long_rows(wide, ["squad_exact_match", "squad_f1"])


def evaluate_labels(df: DataFrame, labels: dict[str, int], prediction: str = "prediction",
                    gold: str = "gold") -> DataFrame:
    """Mistyped labels go to their nearest label, then label ids are compared."""
    corrected = apply_correction(df, prediction, list(labels))
    ids = lookup_label_id(lookup_label_id(corrected, prediction, labels, "_pred_id"), gold, labels, "_gold_id")
    return long_rows(accuracy(ids, "_pred_id", "_gold_id"), ["accuracy"])


def evaluate_texts(df: DataFrame, prediction: str = "prediction", gold: str = "gold",
                   tokenizer: str = "ascii") -> DataFrame:
    """Exact match, chrF and ROUGE of free text, in one scan."""
    pred, truth = F.col(prediction), F.col(gold)
    # A missing prediction is a miss, as it is for the other scores.
    scored = df.select(F.coalesce((pred == truth).cast("int"), F.lit(0)).alias("_hit"), chrf_statistics(pred, truth).alias("_stats"),
                       pred.alias("_pred"), F.array(truth).alias("_golds"))
    wide = with_rouge(scored, "_pred", "_golds", tokenizer).agg(F.avg("_hit").alias("exact_match"), *chrf_sums("_stats", 6),
                      *[F.avg(n).alias(n) for n in _ROUGE])
    return long_rows(wide.withColumn("chrf", chrf_score(6, 2.0)), ["exact_match", "chrf", *_ROUGE])


def evaluate_task(name: str, df: DataFrame, prediction: str = "prediction", gold: str = "gold",
                  labels: dict[str, int] | None = None) -> DataFrame:
    """`metric, value` rows of a named task; `gold` holds answer lists for the two question tasks."""
    if name == "klue-mrc":
        return evaluate_reading(df, prediction, gold)
    if name == "korquad-v1":
        return evaluate_questions(df, prediction, gold)
    table = labels or get_task(name).gold_labels
    return evaluate_labels(df, table, prediction, gold) if table else evaluate_texts(df, prediction, gold)
