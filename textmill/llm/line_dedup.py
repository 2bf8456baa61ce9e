"""Lines that several documents hold stay in one of them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import batch_map, free_name, stored, text_bytes

LINE_WHITESPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: bytes, least: int) -> bytes | None:
    """128-bit digest of the stripped line with A-Z lower-cased; None if it has fewer than `least` code points."""
    line = line.strip(LINE_WHITESPACE)
    if len(line) < least or (not line.isascii() and len(line.decode("utf-8", "replace")) < least):
        return None
    return hashlib.blake2b(line.lower(), digest_size=16).digest()


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """id, mark (of the text), line_no (from 0), key_1 and key_2 for every line of `min_chars` code points or more."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, marks, places, keys = [], [], [], []
        for owner, mark, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
            for place, line in enumerate(text.split(b"\n")):
                key = line_key(line, min_chars)
                if key is not None:
                    ids.append(owner)
                    marks.append(mark)
                    places.append(place)
                    keys.append(key)
        if not ids:
            return None
        halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(places, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
            ["id", "mark", "line_no", "key_1", "key_2"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_mark(text_col).alias("mark"), text_bytes(text_col).alias("text"))
    return batch_map(texts.where("id IS NOT NULL"), work, "id long, mark long, line_no int, key_1 long, key_2 long")


def text_mark(column: str) -> Column:
    """Tells apart the texts of rows that repeat an id."""
    return F.xxhash64(text_bytes(column))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                min_docs: int = 2) -> DataFrame:
    r"""The documents with all their columns, `text_col` without repeated lines, plus n_lines (before) and n_dropped.

    A text is split at \n; a null or empty text is one empty line. A line's key is the line without the characters
    `[\x20\x09-\x0D]` at its ends, with A-Z lower-cased. Keys of at least `min_chars` code points that at least `min_docs`
    documents hold lose all their lines except in the smallest id that holds them, where repeats stay. The other lines
    stay in order, joined by \n.

    Lines are exploded to (id, line number, 128-bit key); documents are counted per key with map-side combination, so
    a frequent line is no hot key there. Keys that go are stored, so that the join back is one of two shuffled tables, whose skewed
    partitions Spark splits. The text itself is shuffled once, to meet its dropped line numbers.

    Rows with a null id keep all their lines and count as no document. Rows that repeat an id are one document; each loses the lines of its
    own text that a smaller id holds. Very long texts are split in one task. An empty table gives no rows. Result columns replace input columns of the
    same name; the names of working columns are chosen free of those of the table.
    """
    lines = stored(line_hashes(docs, id_col, text_col, min_chars), "lines")
    # Two documents at least exactly if the smallest and the largest id differ; more needs a count of distinct ids.
    grouped = lines.groupBy("key_1", "key_2")
    if min_docs <= 2:
        owners = grouped.agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
        owners = owners.where("first_id < last_id" if min_docs == 2 else "true").drop("last_id")
    else:
        owners = (lines.select("key_1", "key_2", "id").distinct().groupBy("key_1", "key_2")
                  .agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where(F.col("n") >= min_docs).drop("n"))
    key, mark, places, all_lines, gone_lines = (free_name(n, docs.columns) for n in ("_id", "_mark", "_dropped", "_lines", "_gone"))
    dropped = (lines.join(stored(owners, "owners"), ["key_1", "key_2"]).where("id <> first_id")
               .groupBy(F.col("id").alias(key), F.col("mark").alias(mark)).agg(F.collect_set("line_no").alias(places)))
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(*kept_columns).join(dropped, (F.col(id_col).cast("long") == F.col(key)) & (text_mark(text_col) == F.col(mark)), "left")
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    gone = F.coalesce(F.col(places), F.array().cast("array<int>"))
    # Marks by line number: one pass, where a lookup of each line in the set would be quadratic.
    joined = joined.withColumns({all_lines: split, gone_lines: F.array_sort(gone)})
    pieces = F.transform(F.arrays_zip(
        F.concat(F.array(F.lit(-1)), F.col(gone_lines)).alias("a"), F.concat(F.col(gone_lines), F.array(F.size(all_lines))).alias("b")),
        lambda p: F.slice(F.col(all_lines), p["a"] + 2, p["b"] - p["a"] - 1))
    rest = F.when(F.size(gone_lines) == 0, F.col(all_lines)).otherwise(F.flatten(pieces))
    text = F.when(F.size(gone_lines) == 0, F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(rest, "\n"))
    counted = joined.withColumns({
        text_col: text, "n_lines": F.size(all_lines).cast("long"), "n_dropped": F.size(gone_lines).cast("long")})
    return counted.drop(all_lines, gone_lines, places, key, mark)
