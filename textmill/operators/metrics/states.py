"""Dialogue-state and token-level scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...functions.text import let


def slot_scores(gold: Column, pred: Column) -> Column:
    """`(f1, recall, precision)` of two slot lists by membership; repeated slots count each time.

    With no gold slot all three are 1 if nothing is predicted, and 0 otherwise. A null slot is never equal to another.
    """

    def scores(n: Column) -> Column:
        precision = F.when(n["tp"] + n["fp"] > 0, n["tp"] / (n["tp"] + n["fp"])).otherwise(0.0)
        recall = n["tp"] / F.size(gold)
        f1 = F.when(n["tp"] > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
        return F.struct(f1.alias("f1"), recall.alias("recall"), precision.alias("precision"))

    def side(slots: Column, is_gold: bool) -> Column:
        return F.transform(slots, lambda s: F.struct(s.alias("slot"), F.lit(is_gold).alias("is_gold")))

    def step(state: Column, s: Column) -> Column:
        """The predictions of a slot come before its gold ones; `open` are those that no gold one has met yet."""
        same = F.coalesce(state["slot"] == s["slot"], F.lit(False))
        hit = s["is_gold"] & same
        return F.struct(
            F.when(s["is_gold"], state["slot"]).otherwise(s["slot"]).alias("slot"),
            F.when(hit, 0).when(s["is_gold"], state["open"]).when(same, state["open"] + 1).otherwise(1).alias("open"),
            (state["tp"] + F.when(hit, 1).otherwise(0)).alias("tp"),
            (state["fp"] + F.when(hit, -state["open"]).when(s["is_gold"], 0).otherwise(1)).alias("fp"))

    start = F.struct(F.lit(None).cast("string").alias("slot"), F.lit(0).alias("open"), F.lit(0).alias("tp"), F.lit(0).alias("fp"))
    merged = F.aggregate(F.sort_array(F.concat(side(pred, False), side(gold, True))), start, step,
                         lambda s: F.struct(s["tp"].alias("tp"), s["fp"].alias("fp")))
    blank = (F.size(pred) == 0).cast("double")
    return F.when(F.size(gold) == 0, F.struct(blank.alias("f1"), blank.alias("recall"), blank.alias("precision"))
                  ).otherwise(let(merged, scores))


def dialogue_state_score(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """One row of mean slot scores."""
    scored = df.select(slot_scores(F.col(gold), F.col(pred)).alias("s"))
    return scored.agg(F.avg("s.f1").alias("f1"), F.avg("s.recall").alias("recall"),
                      F.avg("s.precision").alias("precision"), F.count("*").alias("n_rows"))


def equal_positions(pred: Column, labels: Column) -> Column:
    """Positions at which two id arrays agree; a position that only one of them has never agrees."""
    same = F.zip_with(pred, labels, lambda p, g: F.coalesce(p == g, F.lit(False)))
    return F.size(F.filter(same, lambda hit: hit))


def token_accuracy(df: DataFrame, pred: str = "pred_ids", labels: str = "labels",
                   batch: str = "batch_id") -> DataFrame:
    """One row: equal positions over all positions per batch, padding included, averaged over the batches."""
    counts = df.select(batch, equal_positions(F.col(pred), F.col(labels)).alias("same"), F.size(labels).alias("n"))
    per_batch = counts.groupBy(batch).agg((F.sum("same") / F.sum("n")).alias("accuracy"))
    return per_batch.agg(F.avg("accuracy").alias("token_accuracy"), F.count("*").alias("n_batches"))
