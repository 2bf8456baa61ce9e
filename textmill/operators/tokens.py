"""Text columns to padded id batches."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from ..functions.byte_ids import attention_mask, byte_encode, encoded_length, pad_ids
from ..functions.hashing import HASH_RANGE, hash32, hash52
from ..sources.lines import dense_index


def encode_pairs(df: DataFrame, max_len: int | None = None, sentinels: bool = False) -> DataFrame:
    """`input_text, target_text` to `input_ids, labels`, unpadded."""
    others = [c for c in df.columns if c not in ("input_text", "target_text")]
    return df.select(*others, byte_encode(F.col("input_text"), max_len, sentinels).alias("input_ids"),
                     byte_encode(F.col("target_text"), max_len, sentinels).alias("labels"))


def _round_up(length: Column, multiple: int) -> Column:
    return length if multiple == 1 else (F.ceil(length / multiple) * multiple).cast("int")


def pad_batch(df: DataFrame, batch_size: int, max_len: int | None = None, multiple: int = 1,
              order: str = "row_id", dense: bool = False) -> DataFrame:
    """`input_ids, attention_mask, labels` padded to the longest row of the batch.

    Batches are full but for the last: rows are numbered by `order`, a unique key; a text key is ordered by its
    hash, which mixes the sources. With `dense` the key is taken as the number itself, 0, 1, 2 … without gaps, and not
    counted again. The text is shuffled, not the ids: lengths come from byte counts and ids are built after the
    shuffle. `multiple` rounds the padded length up.
    """
    place = order
    if not dense:
        place = "_place"
        numeric = isinstance(df.schema[order].dataType, IntegralType)
        df = dense_index(df if numeric else df.withColumn("_hash", hash52(F.col(order), 0)),
                         order if numeric else "_hash", out=place, tie=order)
    sized = df.withColumn("batch_id", F.floor(F.col(place) / F.lit(batch_size))).drop("_hash", "_place")
    return _padded(sized, ["batch_id"], max_len, multiple)


def pad_by_length(df: DataFrame, token_budget: int, max_len: int | None = None, multiple: int = 64,
                  order: str = "row_id", seed: int | str = 0) -> DataFrame:
    """`bucket, batch_id, input_ids, attention_mask, labels`: batches of rows of like length, for least padding.

    The bucket of a row is the longer of its two encoded lengths, rounded up to `multiple`. A batch holds rows of one bucket only, as
    many as `token_budget` padded ids allow and at least one, so long rows make small batches and no row gets `multiple` ids of padding
    on its longer side. Rows follow each other by bucket, then by a hash of the unique key `order`, and are numbered in blocks
    that are cut at quantiles of both, so a length that many rows share is no hot key. A bucket has at most two batches that aren't full.
    """
    length = F.greatest(*(F.coalesce(encoded_length(F.col(f"{side}_text"), max_len), F.lit(0)) for side in ("input", "target")))
    bucketed = df.withColumn("bucket", _round_up(F.greatest(length, F.lit(1)), multiple))
    mixed = bucketed.withColumn("_mix", F.col("bucket").cast("long") * HASH_RANGE + hash32(F.col(order), seed))
    rows = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket")))
    placed = dense_index(mixed, "_mix", out="_place", tie=order)
    sized = placed.withColumn("batch_id", F.floor(F.col("_place") / rows)).drop("_mix", "_place")
    return _padded(sized, ["bucket", "batch_id"], max_len, 1)


def _padded(sized: DataFrame, keys: list[str], max_len: int | None, multiple: int) -> DataFrame:
    """Encode the texts of batches that `keys` tell apart, padded to the longest row of the batch."""
    batch = Window.partitionBy(*keys)
    others = [c for c in sized.columns if c not in ("input_text", "target_text", *keys)]
    longest = {f"_{side}": _round_up(F.max(encoded_length(F.col(f"{side}_text"), max_len)).over(batch), multiple)
               for side in ("input", "target")}
    encoded = sized.withColumns(longest).select(
        *others, *keys, "_input", "_target", byte_encode(F.col("input_text"), max_len).alias("_input_ids"),
        byte_encode(F.col("target_text"), max_len).alias("_target_ids"))
    return encoded.select(
        *others, *keys, pad_ids(F.col("_input_ids"), F.col("_input")).alias("input_ids"),
        attention_mask(F.col("_input_ids"), F.col("_input")).alias("attention_mask"),
        pad_ids(F.col("_target_ids"), F.col("_target")).alias("labels"))


def length_profile(df: DataFrame, column: str, by: list[str] | None = None,
                   quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Row count, largest and summed encoded length, and exact quantiles; used to choose a length limit.

    A quantile is the least length that at least this share of the lengths does not exceed. Rows are counted by length first, so what
    is ordered are the distinct lengths of a group. Rows without text count as rows only.
    """
    keys, length = by or [], F.col("_length")
    sizes = df.groupBy(*keys, encoded_length(F.col(column)).alias("_length")).agg(F.count("*").alias("_n"))
    sized = F.sum(F.when(length.isNotNull(), F.col("_n")).otherwise(0))
    group = Window.partitionBy(*keys)
    ranked = sizes.withColumns({"_upto": sized.over(group.orderBy("_length")), "_all": sized.over(group)})
    least = [F.min(F.when(F.col("_upto") >= F.ceil(F.lit(Decimal(str(q))) * F.col("_all")), length)) for q in quantiles]
    return ranked.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.max(length).alias("max_length"),
        F.sum(length * F.col("_n")).alias("sum_length"), F.array(*least).alias("quantiles"))
