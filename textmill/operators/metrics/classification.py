"""Label metrics from one confusion count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UNKNOWN = "__unknown__"


def accuracy(df: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    hit = F.coalesce(F.col(pred) == F.col(gold), F.lit(False)).cast("int")
    return df.agg(F.avg(hit).alias("accuracy"), F.count("*").alias("n_rows"))


def exact_match(df: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    hit = F.coalesce(F.col(pred) == F.col(gold), F.lit(False)).cast("int")
    return df.agg(F.avg(hit).alias("exact_match"), F.count("*").alias("n_rows"))


def confusion(df: DataFrame, pred: str = "pred", gold: str = "gold", weight: Column | None = None,
              order: str | None = None) -> DataFrame:
    """`gold, pred, n`, and with `order` its least value `first_row` per cell.

    Counts combine on the map side, so a label that holds a third of the rows is no hot key.
    """
    count = F.count("*") if weight is None else F.sum(weight)
    first = [F.min(order).alias("first_row")] if order else []
    return df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(count.alias("n"), *first)


def class_counts(cells: DataFrame) -> DataFrame:
    """`label, tp, support, predicted, first_row` from confusion cells.

    Each cell adds to its gold and to its predicted class; `first_row` is that of the gold class.
    """
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    first = F.col("first_row").cast("long") if "first_row" in cells.columns else none

    def side(label: str, tp: Column, support: Column, predicted: Column, first_row: Column) -> Column:
        return F.struct(F.col(label).alias("label"), tp.cast("long").alias("tp"), support.alias("support"),
                        predicted.alias("predicted"), first_row.alias("first_row"))

    sides = F.array(side("gold", hit, F.col("n"), zero, first), side("pred", zero, zero, F.col("n"), none))
    return cells.select(F.inline(sides)).groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        F.min("first_row").alias("first_row"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, pred: str = "pred", gold: str = "gold", order: str | None = None,
                          compat: bool = False, digits: int = 4) -> DataFrame:
    """`kind, label, precision, recall, f1, support` for the gold classes, accuracy, macro and weighted averages.

    A prediction that is no gold class counts for no class. With `order` each class has its `first_row`, the order in
    which a report lists the classes. `compat` counts unknown predictions for the class that comes first.
    """
    cells = confusion(df, pred, gold, order=order)
    if compat:
        if order is None:
            raise ValueError("compat needs the row order")
        first = cells.agg(F.min_by("gold", "first_row"))
        known = cells.select(F.col("gold").alias("pred")).distinct().withColumn("_known", F.lit(True))
        cells = cells.join(known, "pred", "left").select(
            "gold", F.when(F.col("_known"), F.col("pred")).otherwise(first.scalar()).alias("pred"), "n", "first_row")
    counts = class_counts(cells).filter(F.col("support") > 0)
    precision, recall = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    f1 = _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    scored = counts.select("label", "tp", "support", "first_row", precision.alias("p"), recall.alias("r"), f1.alias("f"))

    def mean(column: str) -> Column:
        return F.avg(column).alias(column)

    def weighted(column: str) -> Column:
        return (F.sum(F.col(column) * F.col("support")) / F.sum("support")).alias(f"w{column}")

    # Class rows and the total row come from one pass over the class counts.
    totals = scored.rollup("label").agg(
        F.grouping("label").alias("is_total"), F.sum("support").alias("support"), F.sum("tp").alias("tp"),
        F.min("first_row").alias("first_row"), mean("p"), mean("r"), mean("f"), weighted("p"), weighted("r"), weighted("f"))

    def row(kind: str, label: Column, p: Column, r: Column, f: Column) -> Column:
        first_row = F.col("first_row") if kind == "class" else F.lit(None).cast("long")
        return F.struct(F.lit(kind).alias("kind"), label.cast("string").alias("label"),
                        first_row.alias("first_row"), F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"),
                        F.round(f, digits).alias("f1"))

    hit_rate, none = F.col("tp") / F.col("support"), F.lit(None)
    rows = F.when(F.col("is_total") == 0, F.array(row("class", F.col("label"), F.col("p"), F.col("r"), F.col("f")))
                  ).otherwise(F.array(
                      row("accuracy", none, hit_rate, hit_rate, hit_rate),
                      row("macro avg", none, F.col("p"), F.col("r"), F.col("f")),
                      row("weighted avg", none, F.col("wp"), F.col("wr"), F.col("wf"))))
    columns = ["kind", "label", "precision", "recall", "f1", "support"] + (["first_row"] if order else [])
    return totals.select("support", F.inline(rows)).select(*columns)


def first_seen(df: DataFrame, gold: str, order: str) -> DataFrame:
    """`label, first_row`: the least order value per class, the order in which a report lists the classes."""
    return df.groupBy(F.col(gold).alias("label")).agg(F.min(order).alias("first_row"))


def f1_summary(cells: DataFrame) -> DataFrame:
    """One row: macro F1 over the classes of either side, and micro F1, which equals accuracy."""
    per_class = _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    return class_counts(cells).agg(F.avg(per_class).alias("macro_f1"),
                                   (F.sum("tp") / F.sum("support")).alias("micro_f1"))
