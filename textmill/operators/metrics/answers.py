"""Answer metrics: exact match, longest-run overlap and token F1, best over the gold answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ...functions.overlap import longest_runs
from ...functions.text import (let, normalize_question_answer, normalize_reading_answer, normalize_squad_answer,
                               words)

NORMALIZERS = {"reading": normalize_reading_answer, "question": normalize_question_answer}


@F.pandas_udf(ArrayType(IntegerType()))
def common_runs(pred: pd.Series, golds: pd.Series) -> pd.Series:
    """For each gold answer the length of the longest contiguous text that the prediction shares with it, texts of any length.

    A short prediction becomes a suffix automaton, a long one hashes of its windows: a row takes time near-linear in its texts. Null
    texts have no length.
    """
    return pd.Series([None if p is None or gs is None else longest_runs(p, gs) for p, gs in zip(pred, golds)], dtype=object)


def common_run(pred: Column, gold: Column) -> Column:
    """Length of the longest common contiguous text of two answers."""
    return F.get(common_runs(pred, F.array(gold)), F.lit(0))


def run_f(run: Column, pred: Column, gold: Column, beta: float = 1.0) -> Column:
    """F measure of a common run; empty gold text counts as equality."""
    precision = F.when(F.length(pred) > 0, run / F.length(pred)).otherwise(0.0)
    recall = F.when(F.length(gold) > 0, run / F.length(gold)).otherwise(0.0)
    score = (1 + beta ** 2) * precision * recall / (beta ** 2 * precision + recall)
    return (F.when(gold == "", (pred == "").cast("double"))
            .when(precision + recall == 0, 0.0).otherwise(score))


def rouge_w_char(pred: Column, gold: Column, beta: float = 1.0) -> Column:
    return let(common_run(pred, gold), lambda run: run_f(run, pred, gold, beta))


def _best(golds: Column, score) -> Column:
    return F.greatest(F.lit(0.0), F.array_max(F.transform(golds, score)))


def score_reading_answers(df: DataFrame, pred: str = "prediction", golds: str = "golds",
                          blank_if_empty: bool = False) -> DataFrame:
    """Add `em` and `rouge_w`, the best over the gold answers after normalisation.

    `blank_if_empty` scores a question without gold answers against the empty answer instead of giving 0.
    """
    gold = F.col(golds)
    if blank_if_empty:
        gold = F.when(F.size(gold) > 0, gold).otherwise(F.array(F.lit("")))
    # Normalisation is a column of its own, so that it runs once per row and not once per gold answer.
    ready = df.withColumn("_pred", normalize_reading_answer(F.col(pred))).withColumn(
        "_golds", F.transform(gold, normalize_reading_answer))
    ready = ready.withColumn("_runs", common_runs(F.col("_pred"), F.col("_golds")))
    pair = let(F.struct(F.col("_pred").alias("text"), F.col("_runs").alias("runs")), lambda p: F.struct(
        _best(F.col("_golds"), lambda g: (g == p["text"]).cast("double")).alias("em"),
        _best(F.col("_golds"), lambda g, i: run_f(F.get(p["runs"], i), p["text"], g)).alias("rouge_w")))
    return ready.withColumn("_pair", pair).withColumns({"em": F.col("_pair.em"), "rouge_w": F.col("_pair.rouge_w")}
                                                       ).drop("_pred", "_golds", "_runs", "_pair")


def reading_score(df: DataFrame, pred: str = "prediction", golds: str = "golds",
                  blank_if_empty: bool = False) -> DataFrame:
    """One row: mean exact match and mean longest-run F."""
    return score_reading_answers(df, pred, golds, blank_if_empty).agg(
        F.avg("em").alias("exact_match"), F.avg("rouge_w").alias("rouge"), F.count("*").alias("n_rows"))


def numbered_tokens(tokens: Column) -> Column:
    """Each token with the number of its occurrence, so that set operations respect repetitions. Linear but for the sort."""
    def numbered(ordered: Column) -> Column:
        fresh = F.transform(ordered, lambda t, i: F.when(~F.get(ordered, i - 1).eqNullSafe(t), i))
        return let(F.filter(fresh, lambda i: i.isNotNull()), lambda starts: F.flatten(F.transform(
            starts, lambda start, k: repeats(ordered, start, F.coalesce(F.get(starts, k + 1), F.size(ordered)) - start))))

    def repeats(ordered: Column, start: Column, times: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), times - 1), lambda j: F.concat_ws("\u0001", F.get(ordered, start), j.cast("string")))

    return let(F.sort_array(tokens), numbered)


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of two token bags, given as numbered tokens."""
    # 2PR/(P+R) with P = same/|pred| and R = same/|gold|.
    return let(F.size(F.array_intersect(pred, gold)), lambda same: F.when(same == 0, 0.0).otherwise(
        2.0 * same / (F.size(pred) + F.size(gold))))


def score_squad_answers(df: DataFrame, pred: str = "prediction", golds: str = "golds") -> DataFrame:
    """Add `squad_em` and `squad_f1` in 0..1, the best over the gold answers."""
    ready = df.withColumn("_pred", normalize_squad_answer(F.col(pred))).withColumn(
        "_golds", F.transform(golds, normalize_squad_answer))
    tokens = ready.withColumn("_ptok", numbered_tokens(words(F.col("_pred")))).withColumn(
        "_gtok", F.transform("_golds", lambda g: numbered_tokens(words(g))))
    pair = let(F.struct(F.col("_pred").alias("text"), F.col("_ptok").alias("tokens")), lambda p: F.struct(
        _best(F.col("_golds"), lambda g: (g == p["text"]).cast("double")).alias("em"),
        _best(F.col("_gtok"), lambda g: token_f1(p["tokens"], g)).alias("f1")))
    return tokens.withColumn("_pair", pair).withColumns(
        {"squad_em": F.col("_pair.em"), "squad_f1": F.col("_pair.f1")}).drop(
        "_pred", "_golds", "_ptok", "_gtok", "_pair")


def squad_score(df: DataFrame, pred: str = "prediction", golds: str = "golds") -> DataFrame:
    """One row: exact match and token F1, both times 100."""
    return score_squad_answers(df, pred, golds).agg(
        (F.avg("squad_em") * 100).alias("exact_match"), (F.avg("squad_f1") * 100).alias("f1"),
        F.count("*").alias("n_rows"))
