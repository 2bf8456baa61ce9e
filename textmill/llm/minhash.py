"""Near-duplicate texts: SuperMinHash signatures, banding, exact verification and union-find grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import GOLDEN, batch_map, lists_of, mixed, shingle_hashes, stored, text_bytes, word_list
from .components import components

UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)
LOW32, SHIFT32 = np.uint64(0xFFFFFFFF), np.uint64(32)
#: Elements whose permutations are held at once.
ELEMENTS = 1 << 15
#: Pivots of a bucket in the first, second, ... round; the last count is used from there on.
PIVOTS = (1, 32, 992)
#: Of 128 one-bit slots, a pair at similarity 0.75 differs in 16 on average with deviation 3.7.
SKETCH_DISTANCE = 40


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """One row of `slots` ranks for each set of 64-bit hashes; an empty set keeps `UNSET` everywhere.

    Every element draws a random permutation of the slots, one slot a level: at level j it offers the rank j + r, with r
    in [0, 1) drawn anew, to the j-th slot of its permutation (Fisher-Yates, one swap a level). Each slot keeps the
    smallest offer. As an offer of level j is smaller than any of a later level, a set is done at the first level after
    which all its slots are taken. A rank is held as j in the high and r in the low 32 bits.
    """
    out = np.full((len(sets), slots), UNSET, np.uint64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    start = 0
    while start < len(sets):
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), ELEMENTS)))
        if sizes[start:stop].sum():
            _fill(out[start:stop], np.concatenate(sets[start:stop]), np.repeat(np.arange(stop - start), sizes[start:stop]))
        start = stop
    return out


def _draw(elements: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(elements + GOLDEN * np.uint64(2 * level + 1))


def _fill(out: np.ndarray, elements: np.ndarray, owner: np.ndarray) -> None:
    slots = out.shape[1]
    flat = out.reshape(-1)
    drawn = _draw(elements, 0)
    slot = ((drawn >> SHIFT32) * np.uint64(slots) >> SHIFT32).astype(np.int64)
    np.minimum.at(flat, owner * slots + slot, drawn & LOW32)
    places = None
    for level in range(1, slots):
        waiting = (out == UNSET).any(axis=1)
        keep = waiting[owner]
        if not keep.any():
            return
        if not keep.all():
            elements, owner, slot = elements[keep], owner[keep], slot[keep]
            places = places[keep] if places is not None else None
        rows = np.arange(len(elements))
        if places is None:
            places = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
            places[rows, slot] = 0
        drawn = _draw(elements, level)
        picked = level + ((drawn >> SHIFT32) * np.uint64(slots - level) >> SHIFT32).astype(np.int64)
        slot = places[rows, picked].astype(np.int64)
        places[rows, picked] = places[:, level]
        np.minimum.at(flat, owner * slots + slot, (drawn & LOW32) | (np.uint64(level) << SHIFT32))


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each row and band."""
    rows = signatures.shape[1] // bands
    blocks = signatures[:, :rows * bands].reshape(len(signatures), bands, rows)
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, blocks.shape[:2])
        for i in range(rows):
            keys = mixed(keys + blocks[:, :, i] + GOLDEN)
    return keys


def fingerprints(texts: DataFrame, width: int = 5, bands: int = 40, rows: int = 5) -> DataFrame:
    """id, n_shingles, set_key, bands and a 128-bit sketch for each (id, binary text) row.

    Equal shingle sets have equal set keys, a 128-bit digest of the sorted hashes.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(word_list(t), width) for t in batch.column(1).to_pylist()]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        signatures = super_minhash(sets, bands * rows)
        bits = np.packbits((mixed(signatures[:, :128]) >> np.uint64(63)).astype(np.uint8), axis=1)
        bits = np.pad(bits, ((0, 0), (0, 16 - bits.shape[1]))).view(np.int64).reshape(len(sets), 2)
        keys = band_keys(signatures, bands).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]),
             lists_of(keys.reshape(-1), np.full(len(sets), bands), pa.int64()), pa.array(bits[:, 0]), pa.array(bits[:, 1])],
            ["id", "n_shingles", "set_key", "bands", "sketch_1", "sketch_2"])

    return batch_map(texts, work, "id long, n_shingles long, set_key binary, bands array<long>, sketch_1 long, sketch_2 long")


def shingle_sets(texts: DataFrame, width: int = 5) -> DataFrame:
    """id and the distinct shingle hashes of each (id, binary text) row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(word_list(t), width).view(np.int64) for t in batch.column(1).to_pylist()]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), lists_of(np.concatenate(sets), sizes, pa.int64())], ["id", "shingles"])

    return batch_map(texts, work, "id long, shingles array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = 5,
                    bands: int = 40, rows: int = 5) -> DataFrame:
    """id, n_shingles, component_id and kept for every row of `docs`.

    Two texts are linked if 100 * |A & B| >= percent * |A | B| holds for their sets of distinct word shingles, confirmed on
    the whole sets. component_id is the smallest id reachable over links; kept marks the row that has this id.

    Equal sets collapse to the smallest id first, so a group of copies is one vertex however large it is. Candidates share
    a band; at the least similarity a pair is missed with probability (1 - 0.75 ** 5) ** 40 = 2e-5. Inside a bucket a few
    pivots a round are compared with all members that are not in their component yet, then leave the bucket; it is
    closed when one component is left in it. So no pair that could join two components goes unseen, and a bucket of
    similar texts costs one pass, not a pass for each pair.

    A null or empty text has no shingles: it is linked with nothing. A null id is never linked: component_id is its own
    (null) id and the row is kept. Rows that repeat an id give one result row each and are one vertex, linked if any of
    their texts is. An empty table gives no rows. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    prints = stored(fingerprints(texts, width, bands, rows), "prints")
    classes = stored(
        prints.where("n_shingles > 0 AND id IS NOT NULL").groupBy("set_key")
        .agg(F.min(F.struct("id", "n_shingles", "sketch_1", "sketch_2", "bands")).alias("r")).select("set_key", "r.*"), "classes")
    named = classes.select("set_key", F.col("id").alias("first_id"))
    if rounds := list(_merges(texts, classes, percent, width)):
        named = named.join(components(reduce(DataFrame.union, rounds)), F.col("first_id") == F.col("vertex"), "left")
        named = named.select("set_key", F.coalesce("component", "first_id").alias("first_id"))
    result = prints.select("id", "n_shingles", "set_key").join(named, "set_key", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("first_id")).otherwise(F.col("id"))
    return result.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"),
                         own.eqNullSafe(F.col("id")).alias("kept"))


def _merges(texts: DataFrame, classes: DataFrame, percent: int, width: int) -> Iterator[DataFrame]:
    """For each round (vertex, component): which components of the round before have become part of another.

    Before the first round every id is a component. All rounds together connect what all links connect.
    """
    spread = classes.select("id", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    facts = classes.select("id", F.col("n_shingles").alias("n"), "sketch_1", "sketch_2")
    members = stored(spread.join(shared, "band").join(facts, "id"), "members")
    if not members.count():
        return
    wanted = members.select("id").distinct()
    # Different texts under one id count as one vertex: it is linked if any of them is.
    sets = stored(shingle_sets(texts.join(wanted, "id", "left_semi").dropDuplicates(["id", "text"]), width), "sets")
    turn = 0
    current = members.withColumns({"component": F.col("id"), "inside": F.col("n"), "outside": F.lit(0), "bands": F.array("band")})
    while True:
        pivots = PIVOTS[min(turn, len(PIVOTS) - 1)]
        order = Window.partitionBy("band").orderBy(F.xxhash64("id", F.lit(turn)) if turn else F.col("id"))
        chosen = current.withColumn("place", F.row_number().over(order)).where(F.col("place") <= pivots).drop("place")
        chosen = stored(chosen, "pivots")
        pairs = _candidates(chosen, current, percent)
        merged = components(_verified(pairs, sets, percent))
        yield merged
        rest = current.join(chosen.select("band", "id"), ["band", "id"], "left_anti").withColumnRenamed("component", "before")
        rest = rest.join(merged, F.col("before") == F.col("vertex"), "left")
        rest = rest.withColumn("component", F.coalesce("component", "before")).drop("vertex", "before")
        open_bands = (rest.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b"))
                      .where("a < b").select("band"))
        current = stored(rest.join(open_bands, "band", "left_semi"), "open")
        if not current.count():
            return
        if not turn:
            own = stored(sets.join(current.select("id").distinct(), "id", "left_semi"), "open-sets")
            current = stored(_with_bounds(current, chosen, classes, sets, own), "bounded")
            sets = own
        turn += 1


def _with_bounds(members: DataFrame, origins: DataFrame, classes: DataFrame, sets: DataFrame, own: DataFrame) -> DataFrame:
    """The members of open buckets, of which `own` has the sets, with all their bands and two counts that bound what two members
    have in common.

    Only shingles that another member holds count. `inside` of them lie in the set of the bucket's first pivot, `outside`
    do not. Two members share at most the lesser inside and the lesser outside count, which rules out most pairs of
    loose copies of one text.
    """
    # A shingle is held by one member exactly if the smallest and the largest id that hold it are the same.
    single = (own.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("id").alias("id"), F.max("id").alias("last"))
              .where("id = last").groupBy("id").agg(F.collect_list("s").alias("single")))
    placed = members.drop("inside", "outside", "bands").join(origins.select("band", F.col("id").alias("origin")), "band")
    # Both sides of the next joins are dealt by id.
    visits = placed.groupBy("id").agg(F.collect_set("origin").alias("origins"))
    none = F.array().cast("array<long>")
    held = (own.join(visits, "id").join(classes.select("id", "bands"), "id").join(single, "id", "left")
            .select("id", "bands", F.explode("origins").alias("origin"), F.array_except("shingles", F.coalesce("single", none)).alias("held")))
    base = sets.select(F.col("id").alias("origin"), F.col("shingles").alias("base"))
    met = (held.join(base, "origin")
           .select("id", "origin", "bands", F.size(F.array_intersect("held", "base")).alias("inside"), F.size("held").alias("total"))
           .select("id", "origin", "inside", (F.col("total") - F.col("inside")).alias("outside"), "bands"))
    return placed.join(met, ["id", "origin"]).drop("origin")


def _candidates(chosen: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs of a pivot and a member of another component that sizes, counts of shared shingles and sketches do not rule out.

    A pair belongs to the first of the bands in which both lie, so it is met once however many these are.
    """
    p = chosen.select("band", *(F.col(c).alias(f"p_{c}") for c in ("id", "n", "sketch_1", "sketch_2", "component", "inside", "outside", "bands")))
    near = F.bit_count(F.col("sketch_1").bitwiseXOR(F.col("p_sketch_1"))) \
        + F.bit_count(F.col("sketch_2").bitwiseXOR(F.col("p_sketch_2"))) <= SKETCH_DISTANCE
    sized = F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * percent
    differ = (F.col("component") != F.col("p_component")) & (F.col("id") != F.col("p_id"))
    most = F.least("inside", "p_inside") + F.least("outside", "p_outside")
    enough = most * (100 + percent) >= (F.col("n") + F.col("p_n")) * percent
    together = F.zip_with("bands", "p_bands", lambda x, y: x == y)
    first = F.element_at("bands", F.array_position(together, True).cast("int")) == members["band"]
    joined = members.hint("merge").join(p, (members["band"] == p["band"]) & differ & sized & enough & near & first)
    return joined.select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b"),
                         F.least("component", "p_component").alias("low"), F.greatest("component", "p_component").alias("high")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The components (low, high) of the pairs whose whole sets reach the similarity."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(b, "b").join(a, "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    enough = common * 100 >= (F.size("set_a") + F.size("set_b") - common) * percent
    return both.where(enough).select("low", "high")
