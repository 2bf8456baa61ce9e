"""Line files: ordered reading without a global sort, and line output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import fixed_values as fv
from ..functions.text import let

INDEX_BLOCK_ROWS = 1 << 20
#: Shares of the rows that are cut into blocks by themselves, and the step of the block numbers from one share to the next.
BLOCK_CUTS, BLOCK_STEP = 64, 1 << 32


def with_file_row_number(records: DataFrame) -> DataFrame:
    """Add `file_path`, the 0-based `line_no` of each record in its file, and `row_id`, its number in path order.

    `records` must come straight from a file reader. A file split is read by one task in file order, so the position
    inside the split is the distance from the split's first row. Only one summary row per split is shuffled, never
    the text. If the two scans were ever planned with different splits the query fails rather than misnumber.
    """
    placed = records.select(
        "*",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_place"),
    )
    # One row per file split, so at most one per `spark.sql.files.maxPartitionBytes` of input.
    in_file = Window.partitionBy("file_path").orderBy("_split").rowsBetween(Window.unboundedPreceding, 0)
    in_all = Window.orderBy("file_path", "_split").rowsBetween(Window.unboundedPreceding, 0)
    splits = (
        placed.groupBy("file_path", "_split")
        .agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
        .withColumn("_base", F.sum("_rows").over(in_file) - F.col("_rows"))
        .withColumn("_start", F.sum("_rows").over(in_all) - F.col("_rows"))
    )
    step = F.col("_place") - F.col("_first")
    consistent = (step >= 0) & (step < F.col("_rows"))
    checked = F.when(consistent, step).otherwise(
        F.raise_error(F.lit("file splits changed between two scans; set spark.sql.files.minPartitionNum"))
        .cast("long")
    )
    return (
        placed.join(splits, ["file_path", "_split"], "left")
        .withColumn("_step", checked)
        .withColumn("line_no", F.col("_base") + F.col("_step"))
        .withColumn("row_id", F.col("_start") + F.col("_step"))
        .drop("_split", "_place", "_first", "_rows", "_base", "_start", "_step")
    )


def number_in_splits(rows: DataFrame, path: str, split: str, place: str) -> DataFrame:
    """Add the 0-based `line_no` in its file to rows keyed by file, start of the split and a number that rises inside the split.

    A split, which is at most `spark.sql.files.maxPartitionBytes` of a file, is ranked by itself; only its size meets those of the other
    splits of the file.
    """
    key = [path, split]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(path).orderBy(split).rowsBetween(Window.unboundedPreceding, 0)
    bases = sizes.select(*key, (F.sum("_rows").over(before) - F.col("_rows")).alias("_base"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(place)) - 1
    return rows.withColumn("_rank", rank).join(bases, key).withColumn("line_no", F.col("_base") + F.col("_rank")).drop("_base", "_rank")


def read_lines_indexed(spark: SparkSession, paths: str | list[str], line_sep: str | None = None) -> DataFrame:
    """`file_path, line_no, row_id, value`: every line with its 0-based number in its file and in all files.

    `row_id` pairs a prediction file with a gold file line by line, also when each is a folder of part files.
    """
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    lines = reader.text(paths).select("value", "_metadata")
    return with_file_row_number(lines).select("file_path", "line_no", "row_id", "value")


def read_prediction_records(spark: SparkSession, paths, prefix: str = fv.OUTPUT_PREFIX.strip()) -> DataFrame:
    """`row_id, prediction` of a file whose predictions span several lines and start with `prefix`.

    The prefix itself separates the records, so each one is whole whatever the file splits.
    """
    records = read_lines_indexed(spark, paths, line_sep="\n" + prefix)
    whole = F.when(F.col("value").startswith(prefix), F.col("value")).otherwise(F.concat(F.lit(prefix), "value"))
    return records.select("row_id", F.regexp_replace(whole, "\n+$", "").alias("prediction"))


def order_blocks(df: DataFrame, order: str, block_rows: int = INDEX_BLOCK_ROWS, cuts: int = BLOCK_CUTS) -> Column:
    """A block number for each row that rises with an integer column; blocks hold about `block_rows` rows each.

    The column is cut at `cuts` - 1 of its quantiles, and between two of these into equal widths, so that an outlier, or a part with
    many more values than another, widens the blocks of its own share of the rows only. Block numbers are `BLOCK_STEP` times the share plus the
    block in it. Reads the column once; only the borders come to the driver. A null has no block, and so no number.
    """
    shares = [i / cuts for i in range(1, cuts)]
    found = df.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count(order).alias("rows"),
                   F.percentile_approx(F.col(order), shares, 100 * cuts).alias("borders")).first()
    value = F.col(order).cast("long")
    if not found["rows"]:
        return F.when(value.isNotNull(), F.lit(0).cast("long"))
    borders = sorted({int(found["low"]), *(int(b) + 1 for b in found["borders"]), int(found["high"]) + 1})
    blocks = max(1, -(-found["rows"] // (block_rows * (len(borders) - 1))))

    def between(at: Column, first: int, last: int) -> Column:
        """The share, by a search tree over the borders: about log2(cuts) comparisons for each row."""
        if last - first > 1:
            middle = (first + last) // 2
            return F.when(at < borders[middle], between(at, first, middle)).otherwise(between(at, middle, last))
        return F.lit(first)

    lows = F.array(*(F.lit(float(b)) for b in borders[:-1]))
    widths = F.array(*(F.lit(float(b - a)) for a, b in zip(borders, borders[1:])))

    def number(at: Column, share: Column) -> Column:
        # As doubles, since the distance may pass a long; rounding is monotone, so the order stays.
        inside = F.floor((at.cast("double") - F.get(lows, share)) / F.get(widths, share) * float(blocks))
        return share.cast("long") * BLOCK_STEP + F.least(F.greatest(inside, F.lit(0).cast("long")), F.lit(blocks - 1).cast("long"))

    # Bound once: the optimizer would else write a computed column into every comparison.
    placed = let(F.struct(value.alias("at")), lambda v: F.struct(v["at"].alias("at"), between(v["at"], 0, len(borders) - 1).alias("share")))
    return F.when(value.isNotNull(), let(placed, lambda p: number(p["at"], p["share"])))


def dense_index(df: DataFrame, order: str, out: str = "row_id", within: str | None = None,
                block_rows: int = INDEX_BLOCK_ROWS, tie: str | None = None) -> DataFrame:
    """Number rows 0, 1, 2 … in the order of an integer column, unique unless `tie` orders equals, without a global sort.

    Rows are ranked inside blocks of order values, and the block sizes are added up. With `within`, rows are numbered inside its values
    and a block is `block_rows` order values wide. Without, blocks hold about `block_rows` rows, see `order_blocks`; their sizes are added
    up inside each share of the rows and then over the shares, so no task meets all blocks.
    """
    keys = [within] if within else []
    block = F.floor(F.col(order) / F.lit(block_rows)) if within else order_blocks(df, order, block_rows)
    blocked = df.withColumn("_block", block).where(F.col("_block").isNotNull())
    sizes = blocked.groupBy(*keys, "_block").agg(F.count("*").alias("_rows")).withColumn("_share", F.floor(F.col("_block") / BLOCK_STEP))
    inner = Window.partitionBy(*keys, "_share").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    # One row for each share, at most `BLOCK_CUTS` of them where there is no key.
    outer = Window.partitionBy(*keys).orderBy("_share").rowsBetween(Window.unboundedPreceding, 0)
    shares = sizes.groupBy(*keys, "_share").agg(F.sum("_rows").alias("_all")).select(
        *keys, "_share", (F.sum("_all").over(outer) - F.col("_all")).alias("_start"))
    bases = sizes.withColumn("_inside", F.sum("_rows").over(inner) - F.col("_rows")).join(shares, [*keys, "_share"]).select(
        *keys, "_block", (F.col("_start") + F.col("_inside")).alias("_base"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order, *([tie] if tie else []))) - 1
    return (
        blocked.withColumn("_rank", rank)
        .join(bases, [*keys, "_block"])
        .withColumn(out, F.col("_base") + F.col("_rank"))
        .drop("_block", "_rank", "_base")
    )


def line_of(items: Column, is_list: bool = False) -> Column:
    """Text of an output line; list items are joined by tabs."""
    return F.concat_ws("\t", items) if is_list else items.cast("string")


def write_lines(df: DataFrame, path: str, column: str, order: str | None = None) -> None:
    """One item per line. With `order` the files, read in name order, keep the rows sorted by that column.

    Sorting samples its input first, so compute costly columns after sorting and leave `order` out.
    """
    is_list = df.schema[column].dataType.typeName() == "array"
    lines = df.select(*([order] if order else []), line_of(F.col(column), is_list).alias("value"))
    if order:
        lines = lines.orderBy(order).select("value")
    lines.write.text(path)


def write_answer_map(df: DataFrame, path: str, id_col: str = "id", text_col: str = "prediction_text") -> None:
    """One JSON object per line, `{"<id>": "<text>"}`; together the lines are the answer map."""
    answer = F.to_json(F.create_map(F.col(id_col).cast("string"), F.col(text_col)))
    df.select(answer.alias("value")).write.text(path)


def read_answer_map(spark: SparkSession, path: str) -> DataFrame:
    entry = F.explode(F.from_json("value", "map<string,string>")).alias("id", "prediction_text")
    return spark.read.text(path).select(entry)
