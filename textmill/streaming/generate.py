"""Lines that keep arriving, scored as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.prediction import ModelLoader, batch_generate
from ..sources.lines import number_in_splits


def read_line_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """`input_text, file_path, split`: lines of the files that appear in a folder, and the byte at which the task's part of the file begins."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(folder).select(
        F.col("value").alias("input_text"), F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("split"))


def stream_generate(lines: DataFrame, load: ModelLoader, path: str, checkpoint: str,
                    batch_size: int = 1, drain: bool = False) -> StreamingQuery:
    """Append the lines with their `prediction` to `path`, in one folder for each batch.

    A line's `place` rises inside its part of the file, so file, part and place are its key. Stateless, so nothing is kept
    between triggers. A batch that is run again, as after a failure, holds the same files and replaces its own folder, so every line
    is there once. `drain` processes what is there and stops.
    """
    def save(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("place", F.monotonically_increasing_id())
        batch_generate(keyed, load, batch_size).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = lines.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    if drain:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """`file_path, line_no, input_text, prediction` of all batches so far, keyed as `read_lines_indexed` keys the lines of gold files."""
    return number_in_splits(spark.read.parquet(path), "file_path", "split", "place").select(
        "file_path", "line_no", "input_text", "prediction")
