"""Registered queries: each runs an operator over the given tables and is paired with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import dealt


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class Registry(dict):
    """Query name to `Query`; `add` registers a function under its own name."""

    def add(self, sql: str | None = None, ints: tuple[str, ...] = ()):
        """`ints` names the SQL columns to narrow to 32 bits, the type of array positions and sizes in Spark."""
        if ints:
            sql = f"SELECT * REPLACE ({', '.join(f'({c})::INT AS {c}' for c in ints)}) FROM ({sql})"

        def register(run):
            self[run.__name__] = Query(run, sql)
            return run

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for costly row work, dealt out if the session asks for it."""
    return dealt(table(spark, sf_dir, name))


def sql_hash(key: str, seed: int | str) -> str:
    """SQL for the 32-bit hash of a key."""
    return f"(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT)"


def all_queries() -> Registry:
    from . import data, files, formats, masks, predictions, scores, tokens

    merged = Registry()
    for module in (data, files, formats, tokens, masks, predictions, scores):
        merged.update(module.QUERIES)
    return merged
