"""Sampling, splits, filters, rebalancing and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from ..functions.byte_ids import encoded_length
from ..functions.hashing import HASH_RANGE, hash32, hash_bucket, hash_unit
from ..sources.lines import order_blocks
from .dialogue import carry_forward

_COARSE_BUCKETS = 1 << 20
_DEDUP_BLOCK_ROWS = 1 << 16


def shard_sample(df: DataFrame, n: int, seed: int, index: int = 0, key: str = "row_id",
                 exact: bool = False, only: Column | None = None) -> DataFrame:
    """Keep one of `n` pseudo-random shards.

    By default a row predicate on the key's hash, so about 1/n of the rows and no shuffle; with `only`, rows outside
    that condition are all kept. `exact` keeps the rows whose rank in hash order lies in the shard's range, so shard
    sizes differ by at most one.
    """
    if not exact:
        chosen = hash_bucket(F.col(key), n, seed) == index
        return df.filter(chosen if only is None else ~only | chosen)
    if only is not None:
        raise ValueError("exact shards are taken of all rows")
    hashed = df.withColumn("_hash", hash32(F.col(key), seed)).withColumn(
        "_coarse", F.floor(F.col("_hash") / F.lit(HASH_RANGE // _COARSE_BUCKETS)))
    # At most 2^20 summary rows, whatever the size of `df`.
    counts = hashed.groupBy("_coarse").agg(F.count("*").alias("_rows"))
    running = Window.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    ranked = counts.select(
        "_coarse", "_rows", (F.sum("_rows").over(running) - F.col("_rows")).alias("_base"),
        F.sum("_rows").over(everything).alias("_total"),
    ).withColumns({
        "_low": F.floor(F.col("_total") * index / n), "_high": F.floor(F.col("_total") * (index + 1) / n)})
    touched = ranked.filter((F.col("_base") < F.col("_high")) & (F.col("_base") + F.col("_rows") > F.col("_low")))
    candidates = hashed.join(F.broadcast(touched), "_coarse")
    whole = (F.col("_base") >= F.col("_low")) & (F.col("_base") + F.col("_rows") <= F.col("_high"))
    # Only the two boundary buckets, about one row in 2^19, need ranks.
    order = Window.partitionBy("_coarse").orderBy("_hash", key)
    rank = F.col("_base") + F.row_number().over(order) - 1
    boundary = candidates.filter(~whole).withColumn("_rank", rank).filter(
        (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    return candidates.filter(whole).select(df.columns).unionByName(boundary.select(df.columns))


def shuffle_rows(df: DataFrame, seed: int, key: str = "row_id") -> DataFrame:
    """Reproducible global random order; a range-partitioned sort, for outputs whose order is seen."""
    return df.orderBy(hash32(F.col(key), seed), key)


def train_test_split(df: DataFrame, test: float = 0.0, valid: float = 0.0,
                     seeds: tuple[int, int] = (fv.TEXT_TEST_SEED, fv.TEXT_VALID_SEED),
                     key: str = "row_id") -> DataFrame:
    """Add `split`: the test rows first, then the validation rows out of the remainder. One scan, no shuffle."""
    split = F.lit("train")
    if valid > 0:
        split = F.when(hash_unit(F.col(key), seeds[1]) < valid, "validation").otherwise(split)
    if test > 0:
        split = F.when(hash_unit(F.col(key), seeds[0]) < test, "test").otherwise(split)
    return df.withColumn("split", split)


def row_length(columns: list[str], unit: str = "bytes") -> Column:
    """Summed length of text columns: byte ids with one end mark per column, or characters."""
    sizes = [encoded_length(F.col(c)) if unit == "bytes" else F.length(c) for c in columns]
    total = sizes[0]
    for size in sizes[1:]:
        total = total + size
    return total


def filter_by_length(df: DataFrame, limit: int | None, columns: list[str], unit: str = "bytes",
                     truncate: bool = False, split: str | None = "split") -> DataFrame:
    """Drop rows whose summed length reaches `limit`; the test split is never filtered.

    With `truncate` nothing is dropped, since the encoder cuts instead.
    """
    if truncate or not limit:
        return df
    fits = row_length(columns, unit) < limit
    return df.filter(fits if split is None else (F.col(split) == "test") | fits)


def reduce_answers(df: DataFrame, column: str = "answers") -> DataFrame:
    """Replace an answer list by its last answer."""
    last = F.get(F.col(column), F.size(column) - 1)
    return df.withColumn(column, last)


def rebalance(df: DataFrame, flag: str = "plausible_answer", seed: int = fv.REBALANCE_SEED,
              key: str = "row_id", only: Column | None = None) -> DataFrame:
    """Repeat half of the answerable and half of the unanswerable rows, in one pass without a union.

    With `only`, rows outside that condition stay single.

    `copy_no` is 0 for the original row and 1 for the repeated one; `key` and `copy_no` together stay unique.
    """
    half = hash_bucket(F.col(key), 2, seed) == 0
    repeated = half & F.col(flag).isNotNull() & (F.lit(True) if only is None else only)
    copies = F.when(repeated, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("copy_no", F.explode(copies))


def content_hash(text: Column) -> Column:
    return F.concat_ws(":", F.md5(text), F.octet_length(text).cast("string"))


def dedup_passages(df: DataFrame, text: str = "text", key: str = "row_id") -> DataFrame:
    """Keep the row with the least key of each distinct text.

    Texts that occur more than once are found on hashes alone with map-side combining, so a text that makes up a third
    of all rows costs one partial result per task. Only the keys of their later copies meet the rows, which are few in most
    corpora and may then be broadcast by the optimizer.
    """
    hashed = df.select(content_hash(F.col(text)).alias("_hash"), F.col(key).alias("_key"))
    repeated = hashed.groupBy("_hash").agg(F.min("_key").alias("_least"), F.count("*").alias("_n")).filter("_n > 1")
    dropped = hashed.join(repeated.drop("_n"), "_hash").filter(F.col("_key") != F.col("_least")).select("_key")
    return df.join(dropped, F.col(key) == F.col("_key"), "left_anti")


def dedup_consecutive(df: DataFrame, text: str = "text", order: str = "line_no",
                      within: str | None = None, block_rows: int = _DEDUP_BLOCK_ROWS) -> DataFrame:
    """Drop a row whose text equals that of the row just before it in the order of a unique integer column.

    Rows are compared inside blocks, and across blocks through the last row of each, so no group grows with the data and there is no
    global sort. A block is `block_rows` order values of one `within` wide; without `within` it holds about as many rows, however the
    order values are spread. Only keys and hashes are ordered; the text meets the numbers of the dropped rows.
    """
    hashed = df.select(F.col(order).alias("_order"), F.col(within).alias("_key") if within else F.lit(0).alias("_key"),
                       content_hash(F.col(text)).alias("_hash"))
    beside = carry_forward(hashed, "_key", "_order", {"_before": F.col("_hash")}, {}, block_rows,
                           None if within else order_blocks(hashed, "_order", block_rows))
    dropped = beside.filter(F.col("_hash").eqNullSafe(F.col("_before"))).select("_key", "_order")
    same = F.col(order) == F.col("_order")
    return df.join(dropped, same & F.col(within).eqNullSafe(F.col("_key")) if within else same, "left_anti")


def keep_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate holds; a null predicate drops the row."""
    return df.filter(predicate)
