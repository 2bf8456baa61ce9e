"""Helpers shared by the pipeline operators: stored intermediate tables, byte views of texts, hashing in Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: computed once, and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(base: str, columns: list[str]) -> str:
    """`base`, with as many underscores after it as make it no column of the table."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; a null text counts as an empty one."""
    return F.coalesce(F.col(column).cast("binary"), F.lit("").cast("binary"))


def batch_map(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """`work` on each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                if made is not None and made.num_rows:
                    yield made

    return df.mapInArrow(run, schema)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> _S30)) * _MIX_1
        values = (values ^ (values >> _S27)) * _MIX_2
        return values ^ (values >> _S31)


def word_list(text: bytes) -> list[bytes]:
    r"""Words `[^\x20\x09-\x0D]+` with A-Z lower-cased; other bytes of UTF-8 are never touched."""
    return text.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: list[bytes], width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; with fewer words than `width`, of the whole sequence."""
    if not words:
        return np.empty(0, np.uint64)
    hashed = word_hashes(words)
    span = min(width, len(words))
    count = len(words) - span + 1
    with np.errstate(over="ignore"):
        rolled = np.full(count, np.uint64(span) * GOLDEN, np.uint64)
        for i in range(span):
            rolled = mixed(rolled + hashed[i:i + count] + GOLDEN)
    return np.unique(rolled)


def lists_of(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key's text modulo `modulus`; the text of a null key is empty."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
