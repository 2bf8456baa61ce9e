"""Label tables: class encoding, id to text, and repair of mistyped labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nearest import LabelTrie
from ..functions.text import let
from ..session import cut_lineage

LabelMap = dict | DataFrame | Callable[[Column], Column]

#: Characters of the labels in a block of the exact search, values searched in it at once, and copies of a table that a join on
#: few keys is spread over.
LABEL_BLOCK, VALUE_BLOCK, SPREAD = 1 << 22, 1 << 15, 16


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def _unmapped(value: Column) -> Column:
    return F.raise_error(F.concat(F.lit("no label entry for: "), F.coalesce(value.cast("string"), F.lit("null"))))


def map_labels(df: DataFrame, column: str, mapping: LabelMap | None, out: str | None = None,
               unmapped: str = "raise") -> DataFrame:
    """Replace ids by texts. `mapping` is a dict, a two-column table, a Column function, or None for no change.

    A value without entry fails the job, or with `unmapped="flag"` gives null and a true `<out>_unmapped`. A dict of any size is
    a literal inside the row, searched from its beginning; its values keep their type. For thousands of entries pass
    a table: it is joined, and whether it is broadcast is left to the optimizer, which knows its size.
    """
    out = out or column
    value = F.col(column)
    if mapping is None:
        return df.withColumn(out, value)
    if not isinstance(mapping, (dict, DataFrame)):
        return df.withColumn(out, mapping(value))
    if isinstance(mapping, dict):
        joined = df.withColumn("_found", F.try_element_at(literal_map(mapping), value))
    else:
        joined = df.join(mapping.toDF("_key", "_found"), F.col("_key") == value, "left").drop("_key")
    if unmapped == "flag":
        result = joined.withColumn(f"{out}_unmapped", F.col("_found").isNull()).withColumn(out, F.col("_found"))
    else:
        result = joined.withColumn(out, F.coalesce("_found", _unmapped(value)))
    return result.drop("_found")


def encode_class(df: DataFrame, column: str, names: Sequence[str], out: str | None = None,
                 unmapped: str = "raise") -> DataFrame:
    """Class name to class id, the position in `names`."""
    return map_labels(df, column, {name: i for i, name in enumerate(names)}, out, unmapped)


def decode_class(df: DataFrame, column: str, names: Sequence[str], out: str | None = None,
                 unmapped: str = "raise") -> DataFrame:
    """Class id to class name."""
    return map_labels(df, column, dict(enumerate(names)), out, unmapped)


def nearest_label(text: Column, labels: Sequence[str]) -> Column:
    """Label with the least edit distance; the first one wins a tie. A label maps to itself without any distance.

    The labels are a literal array, so this stays inside the row: no join, no shuffle, no hot key.
    """
    table = F.array(*[F.lit(label) for label in labels])

    def closest(value: Column) -> Column:
        scored = F.transform(table, lambda label, i: F.struct(
            F.levenshtein(value, label).alias("distance"), i.alias("place"), label.alias("label")))
        return F.array_min(scored)["label"]

    return F.when(text.isin(list(labels)), text).otherwise(let(text, closest))


def count_labels(df: DataFrame, column: str) -> DataFrame:
    """`label, n` per distinct label; lists are flattened first."""
    if df.schema[column].dataType.typeName() == "array":
        labels = df.select(F.explode(column).alias("label"))
    else:
        labels = df.select(F.col(column).alias("label"))
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def _deletions(text: Column, reach: int) -> Column:
    """Hashes of the text and of all that is left of it when up to `reach` characters go."""
    def shorter(word: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.overlay(word, F.lit(""), i, F.lit(1)))
        return F.when(F.length(word) > 0, cuts).otherwise(F.array().cast("array<string>"))

    found = level = F.array(text)
    for _ in range(reach):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        found = F.concat(found, level)
    return F.array_distinct(F.transform(found, lambda word: F.xxhash64(word)))


def nearest_in_table(values: DataFrame, labels: DataFrame, reach: int = 1) -> DataFrame:
    """`label, corrected`: each of the distinct `values` (one column) with its nearest label; nulls are left out.

    `labels` holds `label, place`; the smallest place wins a tie. Two texts at a distance of at most `reach` become equal when each
    loses at most that many characters, so values meet only labels with which they share such a rest, by an equi-join, and
    the distance itself decides. Values without a label within reach are searched in tries of blocks of labels of about
    `LABEL_BLOCK` characters. Both ways are exact. The index takes about length ** reach keys for each label and value.
    """
    table = labels.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min("place").alias("place"))
    wanted = values.toDF("value").filter(F.col("value").isNotNull())
    index = table.select("label", "place", F.explode(_deletions(F.col("label"), reach)).alias("key"))
    scored = F.struct(F.levenshtein("value", "label").alias("distance"), F.col("place"), F.col("label"))
    met = wanted.select("value", F.explode(_deletions(F.col("value"), reach)).alias("key")).join(index, "key").select(
        "value", scored.alias("best")).groupBy("value").agg(F.min("best").alias("best"))
    within = F.col("best.distance") <= reach
    found = cut_lineage(wanted.join(met, "value", "left"))
    near, far = found.filter(within), found.filter(~F.coalesce(within, F.lit(False)))

    n_chars, n_far = table.agg(F.sum(F.length("label") + 1)).first()[0] or 0, far.count()
    n_blocks, spread = n_chars // LABEL_BLOCK + 1, max(SPREAD, n_far // VALUE_BLOCK + 1)
    copies = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    blocks = table.select("label", "place", F.pmod(F.xxhash64("label"), F.lit(n_blocks)).cast("int").alias("block"), copies.alias("spread"))
    dealt = far.select("value", F.col("best.distance").alias("bound"), F.pmod(F.hash("value"), F.lit(spread)).alias("spread"),
                       F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    left, right = (df.repartition(n_blocks * spread, "block", "spread").groupBy("block", "spread") for df in (dealt, blocks))
    place = labels.schema["place"].dataType.simpleString()
    compared = left.cogroup(right).applyInArrow(_nearest_in_block, f"value string, best struct<distance:int,place:{place},label:string>")
    return near.unionByName(compared.groupBy("value").agg(F.min("best").alias("best"))).select(
        F.col("value").alias("label"), F.col("best.label").alias("corrected"))


def _nearest_in_block(values: pa.Table, labels: pa.Table) -> pa.Table:
    """`value, best` for the values that have a label within their bound in the block."""
    values, labels = values.select(["value", "bound"]), labels.select(["label", "place"]).sort_by([("place", "ascending"), ("label", "ascending")])
    if len(values) and len(labels):
        distances, ranks = LabelTrie(labels["label"].to_pylist()).nearest(values["value"].to_pylist(), values["bound"].to_pylist())
    else:
        distances, ranks = np.zeros(len(values), dtype=np.int64), np.full(len(values), -1)
    hits = np.flatnonzero(ranks >= 0)
    chosen = labels.take(ranks[hits])
    best = pa.StructArray.from_arrays([pa.array(distances[hits].astype(np.int32)), chosen["place"].combine_chunks(),
                                       chosen["label"].combine_chunks()], ["distance", "place", "label"])
    return pa.table({"value": values["value"].take(hits), "best": best})


def correction_map(df: DataFrame, column: str, labels: Sequence[str] | DataFrame) -> DataFrame:
    """`label, corrected, n`: each distinct prediction that is not a label, with its nearest label.

    `labels` is a short list, or for thousands of labels a table `(label, place)`, which is indexed.
    """
    distinct = count_labels(df, column)
    if isinstance(labels, DataFrame):
        wrong = distinct.join(labels.select("label"), "label", "left_anti")
        return wrong.join(nearest_in_table(wrong.select("label"), labels), "label").select("label", "corrected", "n")
    return distinct.filter(~F.col("label").isin(list(labels))).select(
        "label", nearest_label(F.col("label"), labels).alias("corrected"), "n")


def apply_correction(df: DataFrame, column: str, labels: Sequence[str] | DataFrame, out: str | None = None) -> DataFrame:
    """Replace every prediction by its nearest label: row by row for a list, by way of the distinct predictions for a table.

    The corrections of a table are joined back. Their copies are made after they are grouped, so a frequent prediction is spread over
    `SPREAD` keys, and skew handling may split each of these. A null prediction stays null there.
    """
    out = out or column
    if not isinstance(labels, DataFrame):
        return df.withColumn(out, nearest_label(F.col(column), labels))
    fixed = correction_map(df, column, labels).select(
        F.col("label").alias("_wrong"), F.col("corrected").alias("_right"),
        F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_copy"))
    dealt = df.withColumn("_mine", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    joined = dealt.join(fixed, (F.col(column) == F.col("_wrong")) & (F.col("_mine") == F.col("_copy")), "left")
    return joined.withColumn(out, F.coalesce("_right", F.col(column))).drop("_wrong", "_right", "_copy", "_mine")


def lookup_label_id(df: DataFrame, column: str, labels: dict[str, int], out: str) -> DataFrame:
    """Label text to id; unknown text gives null."""
    return map_labels(df, column, labels, out, unmapped="flag").drop(f"{out}_unmapped")
