"""Attachment scores of dependency predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...functions import fixed_values as fv
from .classification import confusion, f1_summary

_RELATION = r"(?d)^\((.+?), ([0-9]+), ([A-Z_]+)\)"


def parse_dependencies(line: Column) -> Column:
    """`(head, label, failed)` per relation of a `deprel: ` line.

    An unparsable relation has head and label -2, an unknown label is -2, and rare labels are merged into -3.
    """
    classes = F.array(*[F.lit(name) for name in fv.DEPENDENCY_LABELS])
    bad = F.lit(fv.DEPENDENCY_BAD)

    def relation(part: Column) -> Column:
        name = F.regexp_extract(part, _RELATION, 3)
        index = (F.array_position(classes, name) - 1).cast("int")
        label = (F.when(index < 0, bad).when(index >= fv.DEPENDENCY_RARE_FROM, F.lit(fv.DEPENDENCY_RARE))
                 .otherwise(index))
        head = F.regexp_extract(part, _RELATION, 2).try_cast("int")
        return F.struct(F.coalesce(head, bad).alias("head"), label.alias("label"), (name == "").alias("failed"))

    return F.transform(F.split(F.substr(line, F.lit(len("deprel: ") + 1)), "▁", -1), relation)


def dependency_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """The relation lines of a prediction file; word counts and other lines are left out."""
    return lines.filter(F.col(line).startswith("depre"))


def align_dependencies(df: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Add `pairs`, `(gold_head, head, gold_label, label)` per gold word, and `shorter`, `longer`, `failures`.

    A short prediction is filled with -2, a long one is cut, and a wrong head makes the label -2.
    """
    parsed = df.withColumn("_p", parse_dependencies(F.col(pred))).withColumn("_g", parse_dependencies(F.col(gold)))
    bad = F.lit(fv.DEPENDENCY_BAD)

    def pair(g: Column, p: Column) -> Column:
        head = F.coalesce(p["head"], bad)
        label = F.when(g["head"] != head, bad).otherwise(F.coalesce(p["label"], bad))
        return F.struct(g["head"].alias("gold_head"), head.alias("head"), g["label"].alias("gold_label"),
                        label.alias("label"))

    cut = F.slice("_p", F.lit(1), F.size("_g"))
    return parsed.withColumns({
        "pairs": F.zip_with("_g", cut, pair),
        "shorter": F.size("_p") < F.size("_g"), "longer": F.size("_p") > F.size("_g"),
        "failures": F.size(F.filter("_p", lambda r: r["failed"])),
    }).drop("_p", "_g")


def attachment_counts(aligned: DataFrame) -> DataFrame:
    """One row: short and long predictions and unparsable relations."""
    return aligned.agg(F.count_if("shorter").alias("n_shorter"), F.count_if("longer").alias("n_longer"),
                       F.sum("failures").alias("n_failures"), F.count("*").alias("n_rows"))


def attachment_scores(aligned: DataFrame) -> DataFrame:
    """`score, macro_f1, micro_f1` times 100 for UAS and LAS."""
    words = aligned.select(F.explode("pairs").alias("w")).select("w.*")
    # One shuffle for both scores: the cells of both are counted together.
    cells = words.groupBy("gold_head", "head", "gold_label", "label").agg(F.count("*").alias("n"))

    def summary(name: str, pred: str, gold: str) -> DataFrame:
        return f1_summary(confusion(cells, pred, gold, F.col("n"))).select(
            F.lit(name).alias("score"), (F.col("macro_f1") * 100).alias("macro_f1"),
            (F.col("micro_f1") * 100).alias("micro_f1"))

    return summary("UAS", "head", "gold_head").unionByName(summary("LAS", "label", "gold_label"))
