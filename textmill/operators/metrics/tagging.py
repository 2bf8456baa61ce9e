"""Entity metrics over `<word:TT>` tagged lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...functions.text import let
from .overlap import chrf

_TAG = "(?d)<(.+?):([A-Z][A-Z])>"


def parse_entities(line: Column) -> Column:
    """`(word, tag)` pairs in order."""
    return F.transform(
        F.arrays_zip(F.regexp_extract_all(line, F.lit(_TAG), 1).alias("word"),
                     F.regexp_extract_all(line, F.lit(_TAG), 2).alias("tag")),
        lambda e: F.struct(e["word"].alias("word"), e["tag"].alias("tag")))


def correct_entities(pred: Column, gold: Column) -> Column:
    """Gold entities whose word the prediction tags alike; the last prediction of a word counts.

    One pass over both lists sorted by word, the predictions of a word in their order before its gold entities.
    """
    def side(entities: Column, is_gold: bool) -> Column:
        return F.transform(entities, lambda e, i: F.struct(
            e["word"].alias("word"), F.lit(is_gold).alias("is_gold"), i.alias("place"), e["tag"].alias("tag")))

    def step(state: Column, e: Column) -> Column:
        hit = e["is_gold"] & (state["word"] == e["word"]) & (state["tag"] == e["tag"])
        return F.struct(
            F.when(e["is_gold"], state["word"]).otherwise(e["word"]).alias("word"),
            F.when(e["is_gold"], state["tag"]).otherwise(e["tag"]).alias("tag"),
            (state["hits"] + F.when(hit, 1).otherwise(0)).alias("hits"))

    none = F.lit(None).cast("string")
    return F.aggregate(F.sort_array(F.concat(side(pred, False), side(gold, True))),
                       F.struct(none.alias("word"), none.alias("tag"), F.lit(0).alias("hits")), step, lambda s: s["hits"])


def entity_f1(df: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """One row: counts, micro precision, recall and F1. A prediction without entities counts as one wrong entity."""
    counted = df.select(entity_counts(F.col(pred), F.col(gold)).alias("_entities"))
    return entity_scores(counted.agg(*entity_sums("_entities")))


def entity_counts(pred: Column, gold: Column) -> Column:
    """(correct, predicted, golds) of a row."""
    return let(parse_entities(pred), lambda p: let(parse_entities(gold), lambda g: F.struct(
        correct_entities(p, g).alias("correct"), F.greatest(F.size(p), F.lit(1)).alias("predicted"), F.size(g).alias("golds"))))


def entity_sums(counts: str) -> list[Column]:
    names = {"correct": "n_correct", "predicted": "n_pred", "golds": "n_gold"}
    return [F.sum(f"{counts}.{part}").alias(name) for part, name in names.items()]


def entity_scores(sums: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 beside the sums."""
    p = F.when(F.col("n_pred") > 0, F.col("n_correct") / F.col("n_pred")).otherwise(0.0)
    r = F.when(F.col("n_gold") > 0, F.col("n_correct") / F.col("n_gold")).otherwise(0.0)
    scored = sums.select("*", p.alias("precision"), r.alias("recall"))
    return scored.withColumn(
        "f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(1e-8)))


def iob_line(line: Column) -> Column:
    """`B-TT I-TT …`, one mark per character of every entity."""
    def marks(e: Column) -> Column:
        inner = F.array_repeat(F.concat(F.lit("I-"), e["tag"]), F.length(e["word"]) - 1)
        return F.concat(F.array(F.concat(F.lit("B-"), e["tag"])), inner)

    return F.array_join(F.flatten(F.transform(parse_entities(line), marks)), " ")


def iob_word_f1(df: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Word F1 of the mark sequences."""
    marks = df.select(iob_line(F.col(pred)).alias("pred"), iob_line(F.col(gold)).alias("gold"))
    return chrf(marks, char_order=0, word_order=1, beta=1.0)
