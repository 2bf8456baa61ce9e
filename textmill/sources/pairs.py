"""Pair files, saved datasets and named tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import strip
from ..operators.dataset import shard_sample
from .lines import read_lines_indexed, with_file_row_number

PAIR_COLUMNS = ("text", "target_text")
_CODECS = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")
_SPLITS = ("train", "validation", "test")


def pair_fields(line: Column, delimiter: str = "\t") -> Column:
    """Fields of a stripped line. There is no quoting on purpose."""
    return F.split(strip(line), f"\\Q{delimiter}\\E", -1)


def parse_pairs(lines: DataFrame, columns=PAIR_COLUMNS, delimiter: str = "\t", line: str = "value") -> DataFrame:
    """Keep lines with exactly `len(columns)` fields; the two characters backslash-n become a newline."""
    fields = F.col("_fields")
    kept = lines.withColumn("_fields", pair_fields(F.col(line), delimiter)).filter(F.size(fields) == len(columns))
    values = [F.replace(fields[i], F.lit("\\n"), F.lit("\n")).alias(name) for i, name in enumerate(columns)]
    others = [c for c in lines.columns if c != line]
    return kept.select(*others, *values)


def rejected_pairs(lines: DataFrame, columns=PAIR_COLUMNS, delimiter: str = "\t", line: str = "value") -> DataFrame:
    """The lines that `parse_pairs` leaves out, with their number of fields."""
    counted = lines.withColumn("field_count", F.size(pair_fields(F.col(line), delimiter)))
    return counted.filter(F.col("field_count") != len(columns))


def read_tsv_pairs(spark: SparkSession, paths, columns=PAIR_COLUMNS, delimiter: str = "\t",
                   with_row_id: bool = False) -> DataFrame:
    """Delimited pairs. `with_row_id` adds `file_path, line_no` as a stable key at the price of a counting scan."""
    lines = read_lines_indexed(spark, paths) if with_row_id else spark.read.text(paths)
    return parse_pairs(lines, columns, delimiter)


def read_jsonl_pairs(spark: SparkSession, paths, with_row_id: bool = False) -> DataFrame:
    """`text, label` from JSON lines; rows where either is missing or blank are dropped.

    `with_row_id` adds the record's number over all files as a stable key at the price of a counting scan.
    """
    rows = spark.read.schema("text string, label string").json(paths)
    if with_row_id:
        rows = with_file_row_number(rows.select("*", "_metadata")).select("row_id", "text", "label")
    return rows.filter((strip(F.col("text")) != "") & (strip(F.col("label")) != ""))


def read_json_records(spark: SparkSession, paths, schema: str, partitions: int | None = None) -> DataFrame:
    """JSON lines with a declared schema, plain or compressed (`.gz`, `.zst`, … by extension).

    A compressed file is read by one task, so the rows are spread again when `partitions` is given.
    """
    rows = spark.read.schema(schema).json(paths)
    return rows.repartition(partitions) if partitions else rows


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """Saved dataset with all its splits together; the `split` column tells them apart."""
    return spark.read.parquet(path)


def source_kind(spark: SparkSession, source: str) -> str:
    """`saved`, `records` or `pairs` by the name of the file, or of the first data file of a folder; `table` for anything else.

    Files with a name like `*.parquet` make a saved dataset, `*.jsonl` or `*.json` hold records, and all others pairs; a codec's
    extension is ignored. An empty folder is a saved dataset.
    """
    name = source
    if not set(source) & set("*?[{"):
        path = spark._jvm.org.apache.hadoop.fs.Path(source)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return "table"
        if files.getFileStatus(path).isDirectory():
            name = _first_data_file(files, path) or ".parquet"
    for codec in _CODECS:
        name = name.removesuffix(codec)
    if name.endswith(".parquet"):
        return "saved"
    return "records" if name.endswith((".jsonl", ".json")) else "pairs"


def _first_data_file(files, folder) -> str | None:
    """Name of a file below a folder that readers don't skip."""
    found = files.listFiles(folder, True)
    while found.hasNext():
        name = found.next().getPath().getName()
        if not name.startswith(("_", ".")):
            return name
    return None


def read_any(spark: SparkSession, source: str, columns=PAIR_COLUMNS, delimiter: str = "\t") -> DataFrame:
    """Read a saved dataset folder, a JSON-lines or pair file, or else a catalog table."""
    kind = source_kind(spark, source)
    if kind == "saved":
        return read_saved(spark, source)
    if kind == "records":
        return read_jsonl_pairs(spark, source)
    return read_tsv_pairs(spark, source, columns, delimiter) if kind == "pairs" else read_table(spark, source)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A named benchmark table of the catalog."""
    return spark.table(name)


def concat_sources(frames: list[DataFrame]) -> DataFrame:
    """All inputs of one role as one dataset; duplicates are kept."""
    return reduce(DataFrame.unionByName, frames)


def read_sources(spark: SparkSession, sources: list[str | tuple], seed: int, columns=PAIR_COLUMNS,
                 delimiter: str = "\t") -> DataFrame:
    """Several inputs of one role with a `row_id`; an input given as `(source, n)` contributes 1/n of its rows.

    `(source, n, kind)` also says what the input is, where its name doesn't tell: saved, records, pairs or table.

    The key is text: the input's number and the row's place in it, so copies of a row are drawn independently. The place
    is the line or record number over all files of the input, for a saved dataset the file below its folder and the row
    in it, split folders included. A named table must bring a unique `row_id` of its own. The two columns of records and pairs are
    named by `columns`; a saved dataset or a table must have the columns of the others.
    """
    frames = []
    for number, item in enumerate(sources):
        source, n, kind = (*item, None)[:3] if isinstance(item, tuple) else (item, 1, None)
        kind = kind or source_kind(spark, source)
        place = F.col("row_id").cast("string")
        if kind == "pairs":
            rows = read_tsv_pairs(spark, source, columns, delimiter, with_row_id=True).drop("file_path", "line_no")
        elif kind == "records":
            rows = read_jsonl_pairs(spark, source, with_row_id=True).withColumnsRenamed({"text": columns[0], "label": columns[1]})
        elif kind == "saved":
            below = F.regexp_extract("_metadata.file_path", f"^.*/{re.escape(source.rstrip('/').rsplit('/', 1)[-1])}/(.*)$", 1)
            file = F.when(below != "", below).otherwise(F.col("_metadata.file_path"))
            rows = read_saved(spark, source).select(
                "*", F.concat_ws(":", file, F.col("_metadata.row_index").cast("string")).alias("row_id"))
        else:
            rows = read_any(spark, source)
        keyed = rows.withColumn("row_id", F.concat_ws(":", F.lit(str(number)), place))
        frames.append(shard_sample(keyed, n, seed) if n > 1 else keyed)
    return concat_sources(frames)


def write_splits(df: DataFrame, path: str) -> None:
    """Save all splits together, one folder per split, so that reading one split prunes the others."""
    df.write.partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    if split not in _SPLITS:
        raise ValueError(f"unknown split {split!r}")
    return read_saved(spark, path).filter(F.col("split") == split)
