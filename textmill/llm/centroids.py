"""Centroid clustering of vectors in exact integer arithmetic, over dictionaries of distinct subvectors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: Rows in a chunk, which has dictionaries of its own.
CHUNK = 4096
#: Squared distances over 64 components fit a long as long as the integers stay below this.
LARGEST = 1 << 27


def usable(vector: Column, dims: int, scale: int) -> Column:
    """True for a vector of `dims` components that are all finite numbers and, scaled, below LARGEST."""
    inside = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float(LARGEST // scale), F.lit(False)))
    return F.coalesce((F.size(vector) == dims) & inside, F.lit(False))


def block_slices(dims: int, width: int) -> list[slice]:
    return [slice(a, min(a + width, dims)) for a in range(0, dims, width)]


def dictionary(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a block and the code of each row."""
    block = np.ascontiguousarray(block)
    rows = block.view([("", block.dtype)] * block.shape[1]).reshape(-1)
    distinct, codes = np.unique(rows, return_inverse=True)
    return distinct.view(block.dtype).reshape(-1, block.shape[1]), codes.reshape(-1).astype(np.int32)


def encoded(vectors: DataFrame, dims: int, scale: int, width: int) -> DataFrame:
    """Chunks of (id, vector) rows: ids, and for each block of dimensions its distinct subvectors and a code for each row.

    Nothing is lost: a row is the concatenation of the subvectors that its codes name. Packed as little-endian 64 and 32-bit integers.
    """
    blocks = block_slices(dims, width)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)
                whole = np.floor(values * scale).astype(np.int64)
                made = [dictionary(whole[:, b]) for b in blocks]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                     pa.array([[d.tobytes() for d, _ in made]], pa.list_(pa.binary())),
                     pa.array([[c.tobytes() for _, c in made]], pa.list_(pa.binary()))],
                    ["ids", "subvectors", "codes"])

    return vectors.mapInArrow(work, "ids array<long>, subvectors array<binary>, codes array<binary>")


def chunks(batch: pa.RecordBatch, dims: int, width: int) -> Iterator[tuple[list, list[tuple[slice, np.ndarray, np.ndarray]]]]:
    """ids and, for each block, its dimensions, subvectors and codes."""
    blocks = block_slices(dims, width)
    for ids, subvectors, codes in zip(*(batch.column(c).to_pylist() for c in ("ids", "subvectors", "codes"))):
        yield ids, [(b, np.frombuffer(d, np.int64).reshape(-1, b.stop - b.start), np.frombuffer(c, np.int32))
                    for b, d, c in zip(blocks, subvectors, codes)]


def nearest(parts: list[tuple[slice, np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the smaller number on ties, and the squared distance.

    Each distinct subvector meets the centroids once; a row sums the partial distances that its codes name.
    """
    total = 0
    for dims, subvectors, codes in parts:
        steps = subvectors[:, None, :] - centroids[None, :, dims]
        total = total + np.einsum("mkd,mkd->mk", steps, steps)[codes]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(best)), best]


def cluster_sums(parts: list[tuple[slice, np.ndarray, np.ndarray]], best: np.ndarray, k: int) -> np.ndarray:
    """For each cluster the number of rows and the sum of each component; subvectors are weighted by how often a cluster holds them."""
    counts = np.bincount(best, minlength=k)
    sums = [counts[:, None]]
    for _, subvectors, codes in parts:
        held = np.bincount(best * len(subvectors) + codes, minlength=k * len(subvectors)).reshape(k, -1)
        sums.append(held @ subvectors)
    return np.concatenate(sums, axis=1)


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10,
                    dims: int = 64, scale: int = 1024, seed: int = 3, width: int = 8) -> DataFrame:
    """`id_col`, cluster, distance, cluster_inertia, inertia and centroid_sha256 for every kept vector.

    A vector is kept if it has `dims` components, none null or non-finite; a component x becomes floor(`scale` * x), x as a double.
    Centroids start as the `k` kept vectors with the smallest lowercase-hex sha256 of "<seed>:<id>", in that order (rows that repeat an id by
    their components; the text of a null id is empty). In each round every vector goes to the nearest centroid by squared distance,
    the smaller number on ties, and each centroid that has vectors becomes the floor of their componentwise mean. After `rounds` rounds
    the vectors are assigned once more. inertia sums the distances, cluster_inertia those of the cluster, and centroid_sha256
    is the digest of the final centroid's components as decimal integers joined by commas.

    The vectors are encoded once, in chunks of some thousand rows: each block of `width` dimensions is a dictionary of its distinct
    subvectors and codes. A round computes the exact distances of every distinct subvector to the centroids, sums
    them by code and returns k * (dims + 1) sums for each task; only these are shuffled, and only the k centroids go through the driver. All
    arithmetic is on integers, so the result doesn't depend on order or partitioning.

    Repeated rows and ids count as often as they occur. With fewer than `k` kept vectors each is a centroid; without any, and for an
    empty table, there are no rows. A null id is kept. Vectors with a component of 2**27 / `scale` or more have no distance that
    a long can hold and are left out like non-finite ones. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(usable(F.col("vector"), dims, scale))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(k).collect()
    result = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], result)
    centroids = np.array([[math.floor(x * scale) for x in r["vector"]] for r in first], np.int64)
    table = stored(encoded(rows, dims, scale, width), "subvectors")

    for _ in range(rounds):
        now = centroids

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(now), dims + 1), np.int64)
            for batch in batches:
                for _, parts in chunks(batch, dims, width):
                    total += cluster_sums(parts, nearest(parts, now)[0], len(now))
            cluster, place = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cluster.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[cluster, place])], ["cluster", "place", "total"])

        found = table.mapInArrow(sums, "cluster int, place int, total long").groupBy("cluster", "place").agg(
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        total = {(r["cluster"], r["place"]): int(r["total"]) for r in found}
        centroids = np.array(
            [[total.get((c, 1 + d), 0) // total[c, 0] for d in range(dims)] if (c, 0) in total else now[c] for c in range(len(now))], np.int64)

    last = centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, parts in chunks(batch, dims, width):
                best, distance = nearest(parts, last)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(best.astype(np.int32)), pa.array(distance)], [id_col, "cluster", "distance"])

    assigned = stored(table.mapInArrow(assign, f"{id_col} long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last.tolist()]
    return assigned.select(
        id_col, "cluster", "distance", F.get(F.array(*(F.lit(inertia.get(c, 0)).cast("long") for c in range(len(last)))), F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.get(F.array(*map(F.lit, names)), F.col("cluster")).alias("centroid_sha256"))
