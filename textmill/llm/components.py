"""Connected components: union-find inside each partition, then over partitions put together, then star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

EDGES = "hi long, lo long"
#: Edges that are put together in one task, about.
FOLD = 1 << 20


def forest(ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex reachable) for every vertex that is not the smallest of its group."""
    vertices, dense = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
    parent = list(range(len(vertices)))
    half = len(ids_a)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(dense[:half].tolist(), dense[half:].tolist()):
        a, b = root(a), root(b)
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    roots = np.fromiter((root(x) for x in range(len(parent))), np.int64, len(parent))
    moved = np.flatnonzero(roots != np.arange(len(roots)))
    return vertices[moved], vertices[roots[moved]]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches fold into one forest, so memory holds the vertices of a partition and one batch."""
    hi, lo = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        hi, lo = forest(np.concatenate([hi, batch.column(0).to_numpy()]), np.concatenate([lo, batch.column(1).to_numpy()]))
    if len(hi):
        yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], ["hi", "lo"])


def _stars(edges: DataFrame) -> bool:
    """Whether each vertex hangs on one vertex, and that one on none."""
    ends = edges.select(F.col("hi").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("lo", F.lit(0), F.lit(1)))
    per_vertex = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not per_vertex.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def _step(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    return small.union(least.select("u", "m")).where("hi <> lo").distinct()


def _folded(edges: DataFrame) -> DataFrame:
    return stored(edges.mapInArrow(_united, EDGES), "links")


def components(links: DataFrame) -> DataFrame:
    """vertex, component for every linked vertex that is not the smallest of its component.

    `links` has two long columns. A component is named by its smallest vertex. Self-links, repeated links and links with
    a null end change nothing; no links give no rows. The forests of the partitions are put together without a shuffle, up to
    `FOLD` edges in a task; as many edges or fewer are one forest then. If more are left, and putting them together leaves over
    half of them, a round of star contraction follows: a few joins and map-side combined aggregations over the links that are left.
    The number of rounds grows with the logarithm of the longest chain.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    edges = _folded(links.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")))
    while (count := edges.count()) > FOLD:
        edges = _folded(edges.coalesce(-(-count // FOLD)))
        if edges.count() * 2 > count:
            if _stars(edges):
                break
            edges = _folded(_step(edges))
    else:
        if count:
            edges = _folded(edges.coalesce(1))
    return edges.select(F.col("hi").alias("vertex"), F.col("lo").alias("component"))
