"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
DRAW_RANGE = 1 << 52
#: Hash ranges of one source; the range in which its share ends is settled document by document.
RANGES = 1 << 14


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw52(key: Column, seed: int) -> Column:
    """First 52 bits of md5("<seed>:<key>")."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def fill_targets(sizes: DataFrame, percent: int = 150, max_epochs: int = 2) -> DataFrame:
    """`sizes` (source, source_size, weight) with target: the sources' shares of `percent` % of all sizes.

    Each source gets its share by weight, but at most `max_epochs` times its size; what it can't take is shared anew
    among the others by weight until none is above. Ordered by the level (cap / weight) at which they fill up, the sources
    that end at their cap are a prefix, so the redistribution is one running sum over the sources, of which there is one row
    each. If all caps together are smaller than the total, all sources end at their cap.
    """
    caps = sizes.withColumn("_cap", F.col("source_size") * max_epochs)
    every = Window.partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = caps.select(
        "*",
        (F.sum("source_size").over(every) * percent - F.coalesce(F.sum("_cap").over(before), F.lit(0)) * 100).alias("_left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("_weights"))
    # Here this source and all above it share what the sources below leave; it is full if its share reaches its cap.
    full = F.col("_left") * F.col("weight") >= F.col("_cap") * 100 * F.col("_weights")
    filled = filled.withColumn("_full", full)
    # The first source that isn't full has the largest sum of weights among those that aren't.
    level = F.max(F.when(~F.col("_full"), F.struct("_weights", "_left"))).over(every)
    share = level["_left"] * F.col("weight") / (level["_weights"] * 100)
    return filled.select(*sizes.columns, F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (3, 1, 2),
        percent: int = 150, max_epochs: int = 2, seed: int = 11) -> DataFrame:
    """id, source, size, source_size, target, repeats and taken for every document.

    Size is the number of words (a null text has none). Sources in code point order, null last, get the weights in turn.
    repeats is the number of times the mix holds a document: the whole part of target / source_size, and one more for
    documents in the order of a seeded hash of their id until the words of the fractional part are reached; the
    document at the boundary is taken if more than half of it is below. taken = size * repeats.

    The words of each source are summed by hash range first; only the range that holds the boundary is put in order. So no
    task sees a whole source, however large, and the result does not depend on partitions or runs.

    Rows that repeat an id are documents of their own with the same draw, ordered by size then; rows equal in both differ in nothing
    but their place. A null id counts as the empty text in the draw. An empty table gives no rows.
    """
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                              draw52(F.col(id_col), seed).alias("draw"))
                  .withColumn("range", F.floor(F.col("draw") / (DRAW_RANGE // RANGES)).cast("int")), "sizes")
    ranges = stored(rows.groupBy("source", "range").agg(F.sum("size").alias("words")), "ranges")
    sizes = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)),
                                                       (place % len(weights) + 1).cast("int")))
    targets = stored(fill_targets(weighted, percent, max_epochs), "targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("whole", epochs).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    t = plan.select(F.col("source").alias("t_source"), "source_size", "target", "whole", "extra")
    running = F.sum("words").over(Window.partitionBy("source").orderBy("range")) - F.col("words")
    bounds = (ranges.withColumn("below", running).join(t, F.col("source").eqNullSafe(F.col("t_source")))
              .drop("t_source").withColumnsRenamed({"source": "r_source", "range": "r_range"}))
    met = rows.join(bounds, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
    met = met.drop("r_source", "r_range")
    inside = (F.col("below") < F.col("extra")) & (F.col("below") + F.col("words") > F.col("extra"))
    settled = met.where(~inside).withColumn("more", ((F.col("extra") > 0) & (F.col("below") + F.col("words") <= F.col("extra"))).cast("long"))
    within = Window.partitionBy("source", "range").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("below") + F.coalesce(F.sum("size").over(within), F.lit(0))
    boundary = met.where(inside).withColumn("more", (start + F.col("size") / 2 <= F.col("extra")).cast("long"))
    repeats = F.col("whole") + F.col("more")
    return settled.unionByName(boundary).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", repeats.alias("repeats"),
        (F.col("size") * repeats).alias("taken"))
