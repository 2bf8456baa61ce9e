"""The answer map as one JSON object, written by many tasks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Part(WriterCommitMessage):
    name: str | None
    task: int


class AnswerObjectWriter(DataSourceWriter):
    """Tasks write entries, one a line; the commit moves them to their names and writes the brace or comma before each and the last brace."""

    def __init__(self, path: str) -> None:
        self.path, self.job = path, f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Part:
        system, root = fs.FileSystem.from_uri(self.path)
        task, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        first = next(iterator, None)
        if first is None:
            return Part(None, task)
        system.create_dir(f"{root}/{self.job}", recursive=True)
        entry = lambda row: json.dumps({row["id"]: row["answer"]}, ensure_ascii=False)[1:-1].encode()
        with system.open_output_stream(f"{root}/{self.job}/{name}", compression=None, buffer_size=1 << 20) as out:
            out.write(entry(first))
            for row in iterator:
                out.write(b",\n" + entry(row))
            out.write(b"\n")
        return Part(name, task)

    def commit(self, messages: list[Part | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)

        def put(name: str, mark: bytes) -> None:
            with system.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(mark + b"\n")

        parts = sorted((m for m in messages if m and m.name), key=lambda m: m.task)
        put("part-0000000-0.json", b"{")
        for number, part in enumerate(parts, 1):
            if number > 1:
                put(f"part-{number:07d}-0.json", b",")
            system.move(f"{root}/{self.job}/{part.name}", f"{root}/part-{number:07d}-1.json")
        put(f"part-{len(parts) + 1:07d}-0.json", b"}")
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


class AnswerObject(DataSource):
    """`df.write.format("answer_object").mode("append").save(path)` for rows of `id` and `answer`."""

    @classmethod
    def name(cls) -> str:
        return "answer_object"

    def schema(self) -> str:
        return "id string, answer string"

    def writer(self, schema, overwrite: bool) -> AnswerObjectWriter:
        return AnswerObjectWriter(self.options["path"])


def write_answer_object(df: DataFrame, path: str, id_col: str = "id", text_col: str = "prediction_text") -> None:
    """`{"<id>": "<text>", …}` below a new folder: its files, one after the other by name, are one JSON object.

    No task holds all answers; the driver writes only the braces and commas between files. Ids should be unique, as in any object; rows
    without an id are left out, a null text is null.
    """
    df.sparkSession.dataSource.register(AnswerObject)
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("answer"))
    rows.write.format("answer_object").mode("append").save(path)


def read_answer_object(spark: SparkSession, path: str) -> DataFrame:
    """`id, prediction_text` of an object that `write_answer_object` wrote, read by as many tasks as the files allow."""
    lines = spark.read.text(path).where("value NOT IN ('{', ',', '}')")
    entry = F.concat(F.lit("{"), F.regexp_replace("value", ",$", ""), F.lit("}"))
    return lines.select(F.explode(F.from_json(entry, "map<string,string>")).alias("id", "prediction_text"))
