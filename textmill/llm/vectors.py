"""Near-duplicate vectors: tiles along the leading principal component, compared dimension by dimension with suffix bounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch_map, stored
from .components import components

TILE = 8192
BLOCK = 1024
SLACK = 1e-9


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _valid(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    """Double vectors; None for null, empty, zero or not finite ones and such with a null component."""
    out: list[np.ndarray | None] = []
    for value in batch.column(1):
        vector = None
        if value.is_valid and len(value.values) and not value.values.null_count:
            vector = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
            length = np.sqrt(vector @ vector)
            if not np.isfinite(length) or length == 0:
                # A finite vector may still be too long or short to be squared.
                largest = np.abs(vector).max()
                vector = vector / largest if np.isfinite(largest) and largest > 0 else None
        out.append(vector)
    return out


def keyed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, key (128-bit digest of the components; null if the vector links with nothing) and the components as bytes."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [None if v is None else v.tobytes() for v in _valid(batch)]
        keys = [None if d is None else hashlib.blake2b(d, digest_size=16).digest() for d in data]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["id", "key", "vector"])

    chosen = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return batch_map(chosen, work, "id long, key binary, vector binary")


def _matrix(blobs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, with zeros up to `width`, and their dimensions."""
    dims = np.fromiter((len(b) // 8 for b in blobs), np.int64, len(blobs))
    out = np.zeros((len(blobs), width))
    for d in np.unique(dims):
        own = np.flatnonzero(dims == d)
        out[own, :d] = np.frombuffer(b"".join(blobs[i] for i in own), np.float64).reshape(len(own), d)
    return unit_rows(out), dims


def principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    """Columns are the directions of the unit vectors by falling variance. Only width x width sums reach the driver."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, _ = _matrix(batch.column(0).to_pylist(), width)
        sums = np.vstack([rows.T @ rows, rows.sum(axis=0), np.full(width, float(len(rows)))])
        offsets = pa.array(np.arange(width + 3, dtype=np.int32) * width)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(width + 2, dtype=np.int32)),
                                           pa.ListArray.from_arrays(offsets, pa.array(sums.reshape(-1)))], ["place", "sums"])

    def total(table: pa.Table) -> pa.Table:
        sums = np.sum([np.array(x) for x in table.column("sums").to_pylist()], axis=0)
        return pa.Table.from_arrays([table.column("place").slice(0, 1), pa.array([sums.tolist()])], ["place", "sums"])

    kind = "place int, sums array<double>"
    found = batch_map(classes.select("vector"), work, kind).groupBy("place").applyInArrow(total, kind).collect()
    sums = np.array([r["sums"] for r in sorted(found, key=lambda r: r["place"])])
    n = sums[-1, 0]
    mean = sums[-2] / n
    return np.linalg.eigh(sums[:width] / n - np.outer(mean, mean))[1][:, ::-1]


class Tile:
    """Vectors in principal coordinates with the norms of what follows each checkpoint."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, units: np.ndarray, dims: np.ndarray, axes: np.ndarray, steps: list[int]):
        self.ids, self.weights, self.units, self.dims = ids, weights, units, dims
        self.turned = units @ axes
        squares = self.turned ** 2
        self.rest = {k: np.sqrt(squares[:, k:].sum(axis=1)) for k in steps}


def close_pairs(a: Tile, rows: slice, b: Tile, columns: slice, steps: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) numbers within the block whose cosine reaches the threshold.

    Products are summed over the leading dimensions first. What the other dimensions can add is at most the product of the norms
    of the suffixes, so pairs that cannot reach the threshold are dropped at each step. The cosine of the rest is computed from
    the vectors as they came, in double precision.
    """
    x, y = a.turned[rows], b.turned[columns]
    first = steps[0]
    partial = x[:, :first] @ y[:, :first].T
    i, j = np.nonzero(partial + np.outer(a.rest[first][rows], b.rest[first][columns]) >= threshold - SLACK)
    if len(i) * 16 > partial.size:
        # So many are left that one product of the whole block is the cheaper way.
        return np.nonzero((a.units[rows] @ b.units[columns].T >= threshold) & (a.dims[rows][:, None] == b.dims[columns][None, :]))
    product = partial[i, j]
    for before, step in zip(steps, steps[1:]):
        product = product + np.einsum("ij,ij->i", x[i, before:step], y[j, before:step])
        on = product + a.rest[step][rows][i] * b.rest[step][columns][j] >= threshold - SLACK
        i, j, product = i[on], j[on], product[on]
    cosine = np.einsum("ij,ij->i", a.units[rows][i], b.units[columns][j])
    on = (cosine >= threshold) & (a.dims[rows][i] == b.dims[columns][j])
    return i[on], j[on]


def _unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the linked pairs (i, j) have become one; a label is the smallest place of its group."""
    pairs = np.unique(np.stack([labels[i], labels[j]]), axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    if not pairs.shape[1]:
        return labels
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for p, q in pairs.T.tolist():
        p, q = root(p), root(q)
        if p != q:
            parent[max(p, q)] = min(p, q)
    changed = {x: root(x) for x in parent}
    table = np.arange(len(labels))
    table[list(changed)] = list(changed.values())
    return table[labels]


def compare_tiles(a: Tile, b: Tile | None, steps: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, linked vectors, an id of the same group) of the vectors of both tiles that have a link; without b, within a."""
    other = b or a
    ids = np.concatenate([a.ids, b.ids]) if b else a.ids
    shift = len(a.ids) if b else 0
    links, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for r in range(0, len(a.ids), BLOCK):
        for c in range(0 if b else r, len(other.ids), BLOCK):
            i, j = close_pairs(a, slice(r, r + BLOCK), other, slice(c, c + BLOCK), steps, threshold)
            i, j = i + r, j + c
            if not b:
                i, j = i[j > i], j[j > i]
            if len(i):
                links += np.bincount(i, other.weights[j], len(ids)).astype(np.int64)
                links += np.bincount(j + shift, a.weights[i], len(ids)).astype(np.int64)
                labels = _unite(labels, i, j + shift)
    met = np.flatnonzero(links)
    return ids[met], links[met], ids[labels[met]]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
                 tile: int = TILE) -> DataFrame:
    """id, n_links, component_id and kept for every row.

    Two vectors of one dimension are linked if their cosine, in double precision, is at least `threshold` (above 0). n_links counts the other rows
    linked directly, component_id is the smallest id reachable over links, kept marks the row that has it.

    Equal vectors collapse to one with a weight, so a group of copies is one vector. The others are rotated to principal axes
    and cut into tiles along the first of them. Unit vectors with that cosine are at most sqrt(2 - 2 threshold) apart, also along the first axis, so only
    tiles that are no farther apart meet, each two in a task that holds them and nothing else; `close_pairs` compares them. A task
    gives one row for each vector that has a link: their number and a member of its group, never the pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; so do rows with a null id, whose
    component_id is null. Rows that repeat an id are vectors of their own in one component. An empty table gives no rows. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    rows = stored(keyed(vectors, id_col, vector_col), "vectors")
    usable = rows.where("key IS NOT NULL AND id IS NOT NULL")
    classes = stored(usable.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("weight"), F.min("vector").alias("vector")), "classes")
    count, width = classes.agg(F.count("*"), F.max(F.octet_length("vector"))).first()
    blank = rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not count:
        return blank
    width //= 8
    axes = principal_axes(classes, width)
    steps = sorted({max(1, width // 4), max(1, width // 2), width})
    leading = axes[:, 0]

    def project(batch: pa.RecordBatch) -> pa.RecordBatch:
        units, _ = _matrix(batch.column(2).to_pylist(), width)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(units @ leading)], ["first_id", "weight", "vector", "lead"])

    projected = stored(batch_map(classes.select("first_id", "weight", "vector"), project, "first_id long, weight long, vector binary, lead double"), "projected")
    tiles = -(-count // tile)
    shares = [(k + 1) / tiles for k in range(tiles - 1)]
    cuts = np.array(projected.agg(F.percentile_approx("lead", shares, max(10_000, 4 * tiles))).first()[0] if shares else [])
    # Tile t holds the coordinates above cut t - 1 up to cut t; only tiles with a gap within reach meet.
    reach = float(np.sqrt(2 - 2 * threshold)) + SLACK
    lower, upper = np.append(-np.inf, cuts), np.append(cuts, np.inf)
    last_near = np.searchsorted(lower, upper + reach, side="right") - 1

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, weights, lead = (batch.column(k).to_numpy() for k in (0, 1, 3))
        blobs, place = batch.column(2).to_pylist(), np.searchsorted(cuts, lead, side="left")
        out = []
        for t in np.unique(place):
            own = np.flatnonzero(place == t)
            packed = (int(t), ids[own].tobytes(), weights[own].tobytes(), b"".join(blobs[i] for i in own),
                      np.fromiter((len(blobs[i]) for i in own), np.int64, len(own)).tobytes())
            out += [(int(t), u, *packed) for u in range(t, int(last_near[t]) + 1)]
            out += [(s, int(t), *packed) for s in range(int(t)) if last_near[s] >= t]
        kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                          ["a", "b", "tile", "ids", "weights", "vectors", "sizes"])

    def unpack(table: pa.Table, which: int) -> Tile:
        ids, weights, blobs = [], [], []
        for row in table.to_pylist():
            if row["tile"] == which:
                ids.append(np.frombuffer(row["ids"], np.int64))
                weights.append(np.frombuffer(row["weights"], np.int64))
                ends = np.cumsum(np.frombuffer(row["sizes"], np.int64))
                blobs += [row["vectors"][e - s:e] for e, s in zip(ends, np.frombuffer(row["sizes"], np.int64))]
        units, dims = _matrix(blobs, width)
        return Tile(np.concatenate(ids), np.concatenate(weights), units, dims, axes, steps)

    def compare(table: pa.Table) -> pa.Table:
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        present = set(table.column("tile").to_pylist())
        made = (np.empty(0, np.int64),) * 3
        if {a, b} <= present:
            made = compare_tiles(unpack(table, a), unpack(table, b) if a != b else None, steps, threshold)
        return pa.Table.from_arrays([pa.array(c) for c in made], ["first_id", "links", "mate"])

    dealt = batch_map(projected, deal, "a int, b int, tile int, ids binary, weights binary, vectors binary, sizes binary")
    found = stored(dealt.groupBy("a", "b").applyInArrow(compare, "first_id long, links long, mate long"), "found")
    grouped = components(found.where("mate <> first_id").select("first_id", "mate"))
    links = found.groupBy("first_id").agg(F.sum("links").alias("links"))
    named = (classes.select("key", "first_id", "weight").join(links, "first_id", "left")
             .join(grouped, F.col("first_id") == F.col("vertex"), "left")
             .select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "first_id").alias("component_id")))
    result = rows.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
    component = F.coalesce("component_id", "id")
    return result.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         component.eqNullSafe(F.col("id")).alias("kept"))
