"""Language-model scores: context-tree weighting over bytes, beside an add-one word model.

The tree of all contexts that are met lies in the groups of its contexts of three bytes; no task holds it. `ContextTree` is the same model in
one dense table, for corpora that fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import batch_map, mixed, stored, text_bytes, word_hashes, word_list
from .passages import _by, _packed, _unpacked

#: Ends a text; no byte of UTF-8. Before a text stand as many bytes 0 as a context has.
END_BYTE = 0xFF
#: The end of a word sequence, which no word can be.
END_WORD = np.uint64(xxhash.xxh3_64_intdigest(b""))
#: Words that make up more than one in so many training words are looked up inside the tasks; there are at most as many of them.
HEAVY = 1 << 14
#: Words that the lookups of one group should answer for.
GROUP_WORDS = 1 << 22
#: Bytes of the longest context. Every context that is met is kept.
DEPTH = 5
#: `weigh` keeps a context if it precedes at least one in so many bytes.
SHARE = 1 << 15
CHUNK = 1 << 20
SLICE = 4 << 20
#: Bytes of the texts of a home, and bytes whose grams a group should count.
HOME_BYTES = 16 << 20
GROUP_BYTES = 32 << 20
#: Distinct grams that are weighed at a time.
GRAMS = 1 << 17
#: Counts whose estimates come from a table.
TABLE = 1 << 16


def joined(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(data, places, ends, first text) for runs of texts: places of the bytes to predict, and how many of them end each text."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHUNK):
            size += len(texts[stop])
            stop += 1
        pad, end = b"\0" * DEPTH, bytes([END_BYTE])
        data = np.frombuffer(b"".join(x for text in texts[at:stop] for x in (pad, text, end)), np.uint8)
        sizes = np.fromiter(map(len, texts[at:stop]), np.int64, stop - at) + 1
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(np.arange(1, stop - at + 1) * DEPTH, sizes)
        yield data, places, ends, at
        at = stop


def common_contexts(texts: list[bytes], share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, code, count) of the contexts of these texts that precede at least one in `share` of their bytes.

    A code holds the bytes before a place, the newest highest, so shorter contexts are its leading bytes.
    """
    codes = []
    for data, places, _, _ in joined(texts):
        code = np.zeros(len(places), np.uint64)
        for k in range(1, DEPTH + 1):
            code = code << np.uint64(8) | data[places - k].astype(np.uint64)
        codes.append(code)
    ordered = np.concatenate(codes)
    ordered.sort()
    least = len(ordered) / share
    lengths, found, counts = [], [], []
    for length in range(1, DEPTH + 1):
        short = ordered >> np.uint64(8 * (DEPTH - length))
        first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
        n = np.diff(np.append(first, len(short)))
        on = n >= least
        lengths.append(np.full(on.sum(), length, np.int32))
        found.append(short[first[on]].astype(np.int64))
        counts.append(n[on])
    return np.concatenate(lengths), np.concatenate(found), np.concatenate(counts)


@dataclass(frozen=True)
class ContextNodes:
    """Contexts as a table of steps: 256 * node + older byte to the longer context, 0 if there is none; the empty context is node 1.

    Longer contexts have higher numbers.
    """

    steps: np.ndarray
    parents: np.ndarray

    @staticmethod
    def of(lengths: np.ndarray, codes: np.ndarray) -> ContextNodes:
        """From contexts that hold all their shorter forms, too."""
        numbers: dict[tuple[int, int], int] = {(0, 0): 1}
        parents = [0, 0]
        steps = np.zeros((len(codes) + 2, 256), np.int32)
        for length, code in sorted(zip(lengths.tolist(), codes.tolist())):
            parent = numbers[length - 1, code >> 8]
            numbers[length, code] = number = len(parents)
            parents.append(parent)
            steps[parent, code & 255] = number
        return ContextNodes(steps.reshape(-1), np.array(parents))

    def longest(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The node of the longest context before each place."""
        best = at = np.ones(len(places), np.int32)
        for k in range(1, DEPTH + 1):
            at = self.steps[(at << 8) | data[places - k]]
            best = np.maximum(best, at)
        return best


def _rising(counts: np.ndarray, offset: float) -> np.ndarray:
    """log of (offset)(offset + 1)...(offset + count - 1) by Stirling's series."""

    def log_gamma(x: np.ndarray) -> np.ndarray:
        shift = np.zeros_like(x)
        for _ in range(8):
            shift += np.log(x)
            x = x + 1
        return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x ** 3) + 1 / (1260 * x ** 5) - shift

    return log_gamma(counts + offset) - log_gamma(np.full(1, offset))


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _rising(zeros, 0.5) + _rising(ones, 0.5) - _rising(zeros + ones, 1.0)


def bit_counts(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 inner nodes of the binary decomposition, from counts of bytes in the last axis.

    Node 1 decides the highest bit; below node n are 2n (bit 0) and 2n + 1 (bit 1). Column 0 is not used.
    """
    sums = np.zeros((*symbols.shape[:-1], 512))
    sums[..., 256:] = symbols
    for level in range(7, -1, -1):
        low, high = 1 << level, 2 << level
        sums[..., low:high] = sums[..., high:2 * high:2] + sums[..., high + 1:2 * high:2]
    zeros, ones = sums[..., 0::2].copy(), sums[..., 1::2].copy()
    zeros[..., 0] = ones[..., 0] = 0
    return zeros, ones


def symbol_logs(one_probability: np.ndarray) -> np.ndarray:
    """log10 of the probability of each byte from those of a one at the nodes (last axis)."""
    high, low = np.log10(one_probability), np.log10(1 - one_probability)
    out = np.zeros((*one_probability.shape[:-1], 256))
    symbols = np.arange(256)
    for bit in range(7, -1, -1):
        node = (symbols >> (bit + 1)) | (1 << (7 - bit))
        out += np.where(symbols >> bit & 1, high[..., node], low[..., node])
    return out.astype(np.float32)


@dataclass(frozen=True)
class ContextTree:
    """log10 probabilities of bytes: one row of 256 for each node."""

    nodes: ContextNodes
    rows: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the probability of each text and its end."""
        out = np.zeros(len(texts))
        for data, places, ends, at in joined(texts):
            logs = self.rows[(self.nodes.longest(data, places) << 8) | data[places]].astype(np.float64)
            out[at:at + len(ends)] = np.add.reduceat(logs, np.concatenate([[0], ends[:-1]]))
        return out


def _parts(numbers: np.ndarray) -> list[np.ndarray]:
    return [numbers[i:i + 4096] for i in range(0, len(numbers), 4096)]


def weigh(nodes: ContextNodes, codes: np.ndarray, counts: np.ndarray, share: int = SHARE) -> ContextTree:
    """The tree from how often each byte followed where each node was the longest context (256 * node + byte).

    Contexts below one in `share` bytes fall back to their shorter form first. Each of the 255 nodes of the binary decomposition has a
    context tree of its own. There, a context's probability is the mean of its own estimate and of the product of its children's, where
    all places without a longer context kept are one more child; a context without children has its own estimate. The probability
    of a bit mixes the estimates on the path of contexts by the shares these means give them.
    """
    parents = nodes.parents
    size = len(parents)
    total = max(float(counts.sum()), 1.0)
    depth = np.zeros(size, np.int64)
    for node in range(2, size):
        depth[node] = depth[parents[node]] + 1
    # Slices of nodes of one length, a few thousand each; parents come in an earlier length.
    slices = [part for d in range(int(depth[2:].max(initial=0)), 0, -1) for part in _parts(np.flatnonzero(depth == d))]
    own = np.zeros((size, 256))
    own.reshape(-1)[codes] = counts
    every = own.copy()
    for part in slices:
        np.add.at(every, parents[part], every[part])
    kept = every.sum(axis=1) * share >= total
    kept[:2] = False, True
    for part in slices:
        gone = part[~kept[part]]
        np.add.at(own, parents[gone], own[gone])
    # Only the kept ones go on, in the same order.
    kept[0] = True
    number = np.where(kept, np.cumsum(kept) - 1, 0)
    steps = number[nodes.steps.reshape(size, 256)[kept]].astype(np.int32).reshape(-1)
    parents, own, every, depth = number[parents[kept]], own[kept], every[kept], depth[kept]
    size = len(parents)
    slices = [part for d in range(int(depth[2:].max(initial=0)), 0, -1) for part in _parts(np.flatnonzero(depth == d))] + [np.array([1])]
    has_children = np.zeros(size, bool)
    has_children[parents[2:]] = True
    # From the longest up: log of the product of the children's probabilities, the rest being one of them.
    below, shares = np.zeros((size, 256)), np.ones((size, 256), np.float32)
    for part in slices:
        mine = estimate(*bit_counts(every[part]))
        below[part] += estimate(*bit_counts(own[part]))
        inner = has_children[part][:, None]
        shares[part] = np.where(inner, 1 / (1 + np.exp(np.clip(below[part] - mine, -700, 700))), 1.0)
        weighted = np.where(inner, np.logaddexp(mine, below[part]) - np.log(2), mine)
        if part[0] > 1:
            np.add.at(below, parents[part], weighted)
    # From the root down: what the contexts above give, and the weight that is left.
    rows = np.zeros((size, 256), np.float32)
    given, weight = np.zeros((size, 256), np.float32), np.ones((size, 256), np.float32)
    for part in reversed(slices):
        if part[0] > 1:
            given[part], weight[part] = given[parents[part]], weight[parents[part]]
        zeros, ones = bit_counts(every[part])
        given[part] += weight[part] * shares[part] * (ones + 0.5) / (zeros + ones + 1)
        weight[part] *= 1 - shares[part]
        zeros, ones = bit_counts(own[part])
        rows[part] = symbol_logs(given[part] + weight[part] * (ones + 0.5) / (zeros + ones + 1))
    return ContextTree(ContextNodes(steps, parents), rows.reshape(-1))


def word_counts(texts: DataFrame) -> DataFrame:
    """key and n: how often each word, by its hash, is in all (id, binary text) rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in _slices(batch.column(1).to_pylist()):
                hashes = [word_hashes(word_list(t)) for t in data] + [np.full(len(data), END_WORD)]
                keys, n = np.unique(np.concatenate(hashes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return texts.mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in runs of some megabytes, so that the arrays made from them stay small."""
    run: list[bytes] = []
    size = 0
    for text in texts:
        if run and size + len(text) > SLICE:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def grams(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The context and the byte at each place as a number: the newest byte of the context highest, the byte itself lowest."""
    code = np.zeros(len(places), np.int64)
    for k in range(1, DEPTH + 1):
        code = code << 8 | data[places - k]
    return code << 8 | data[places]


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of their values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


def _sent(codes: np.ndarray, values: np.ndarray) -> bytes:
    """Codes in order and a value for each, packed; the bytes of the steps between codes lie plane by plane."""
    steps = np.diff(codes, prepend=np.int64(0))
    return _packed(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), values.tobytes())


def _received(blob: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    steps, values = _unpacked(blob)
    planes = np.frombuffer(steps, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).reshape(-1)), np.frombuffer(values, kind)


def _estimates(zeros: np.ndarray, ones: np.ndarray, known: list[np.ndarray] = []) -> np.ndarray:
    """`estimate`, from tables where counts are small."""
    if not known:
        counts = np.arange(2.0 * TABLE)
        known += [_rising(counts, 0.5), _rising(counts, 1.0)]
    small = (zeros < TABLE) & (ones < TABLE)
    out = np.empty(len(zeros))
    z, o = zeros[small], ones[small]
    out[small] = known[0][z] + known[0][o] - known[1][z + o]
    out[~small] = estimate(zeros[~small].astype(np.float64), ones[~small].astype(np.float64))
    return out


def _bits(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each bit of the bytes of the grams: 256 * context + inner node of the binary decomposition, and the bit."""
    symbol = codes & 255
    for bit in range(7, -1, -1):
        yield codes - symbol + ((symbol >> (bit + 1)) | (1 << (7 - bit))), symbol >> bit & 1


@dataclass(frozen=True)
class Level:
    """Nodes of the decomposition in contexts of one length that are met: 256 * context + node in order, counts, the share of the own
    estimate, and the log of the weighted probability."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    shares: np.ndarray
    weighted: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None = None) -> Level:
        """`below` is the log of the product of the probabilities of the longer contexts; the longest contexts have none."""
        mine = _estimates(zeros, ones)
        if below is None:
            return Level(keys, zeros, ones, np.ones(len(keys)), mine)
        return Level(keys, zeros, ones, 1 / (1 + np.exp(np.clip(below - mine, -700, 700))), np.logaddexp(mine, below) - np.log(2))

    def folded(self) -> tuple[np.ndarray, ...]:
        """The same for the contexts without their oldest byte: keys, zeros, ones and log of the product of the probabilities."""
        return _summed(_shorter(self.keys), self.zeros, self.ones, self.weighted)

    def mixed(self, above: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys, the probability of a one that this and all shorter contexts give, and the weight left to longer ones."""
        given, weight = np.zeros(len(self.keys)), np.ones(len(self.keys))
        if above is not None:
            at = np.searchsorted(above[0], _shorter(self.keys))
            given, weight = above[1][at], above[2][at]
        return (self.keys, given + weight * self.shares * (self.ones + 0.5) / (self.zeros + self.ones + 1), weight * (1 - self.shares))


def _shorter(keys: np.ndarray, by: int = 1) -> np.ndarray:
    return keys >> 8 * (by + 1) << 8 | keys & 255


#: Bytes of the contexts by which grams are grouped. Shorter contexts number at most 65,793, so these go through the driver.
ROOT = 3


def subtrees(codes: np.ndarray, counts: np.ndarray) -> list[Level]:
    """The levels from the longest contexts to those of `ROOT` bytes, from distinct grams and how often they are met."""
    met = [(keys, np.where(bit == 0, counts, 0), np.where(bit == 1, counts, 0)) for keys, bit in _bits(codes)]
    levels = [Level.of(*_summed(*map(np.concatenate, zip(*met))))]
    for _ in range(DEPTH - ROOT):
        levels.append(Level.of(*levels[-1].folded()))
    return levels


def top_levels(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What `Level.mixed` gives for contexts of 0 to ROOT - 1 bytes, from the folded levels of all groups."""
    levels = [Level.of(*_summed(keys, zeros, ones, below))]
    for _ in range(ROOT - 1):
        levels.append(Level.of(*levels[-1].folded()))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for level in reversed(levels):
        out.append(level.mixed(out[-1] if out else None))
    return out


def gram_logs(codes: np.ndarray, levels: list[Level], top: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 of the probability of the byte of each gram after its context.

    Below the longest context that is met at a node, all estimates are even, so the weight that is left counts half.
    """
    tables = list(top)
    for level in reversed(levels):
        tables.append(level.mixed(tables[-1]))
    out = np.zeros(len(codes))
    for keys, bit in _bits(codes):
        one, rest = np.full(len(keys), 0.5), np.arange(len(keys))
        for depth in range(DEPTH, -1, -1):
            known, given, weight = tables[depth]
            if not len(known) or not len(rest):
                continue
            asked = _shorter(keys[rest], DEPTH - depth) if depth < DEPTH else keys[rest]
            at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            hit = known[at] == asked
            one[rest[hit]] = given[at[hit]] + weight[at[hit]] / 2
            rest = rest[~hit]
        out += np.log10(np.where(bit == 1, one, 1 - one))
    return out


def _runs(codes: np.ndarray) -> Iterator[slice]:
    """Slices of ordered grams, some `GRAMS` each, between contexts of `ROOT` bytes."""
    roots = codes >> 8 * (DEPTH + 1 - ROOT)
    at = 0
    while at < len(codes):
        end = int(np.searchsorted(roots, roots[min(at + GRAMS, len(codes)) - 1], side="right"))
        yield slice(at, end)
        at = end


def _home_texts(table: pa.Table) -> tuple[list[int | None], np.ndarray, list[bytes]]:
    ids, trains, texts = [], [], []
    for blob in table.column("a").to_pylist():
        keys, missing, on, sizes, data = _unpacked(blob)
        ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
        ids += [None if m else k for k, m in zip(np.frombuffer(keys, np.int64).tolist(), missing)]
        trains.append(np.frombuffer(on, np.uint8))
        texts += [data[a:b] for a, b in zip([0, *ends], ends)]
    return ids, np.concatenate(trains).astype(bool), texts


def _uid(key: int | None, text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b"%d " % key + text if key is not None else b"x " + text) - (1 << 63)


def homes_of(texts: DataFrame, homes: int) -> DataFrame:
    """part and packed rows of the (id, binary text, trains) rows, by a hash of id and text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, data = batch.column(0), batch.column(1).to_pylist()
        trains = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8)
        missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        keys, sizes = ids.fill_null(0).to_numpy(), np.fromiter(map(len, data), np.int64, len(data))
        uids = np.array([_uid(k, t) for k, t in zip(ids.to_pylist(), data)], np.int64)
        rows = [(home, _packed(*(x[c["row"]].tobytes() for x in (keys, missing, trains, sizes)), b"".join(data[i] for i in c["row"])))
                for home, c in _by(_part(uids.view(np.uint64), homes), homes, row=np.arange(len(data)))]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "a"])

    return batch_map(texts, work, "part int, a binary")


def sent_grams(grouped: DataFrame, groups: int) -> DataFrame:
    """part, home and packed grams of each home with how often its training texts have them, by the group of their shorter contexts."""

    def work(here: pa.Table) -> pa.Table:
        home = here.column("part")[0].as_py()
        _, trains, texts = _home_texts(here)
        codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for chosen in (True, False):
            for run in _slices([t for t, on in zip(texts, trains) if on == chosen]):
                found, n = np.unique(np.concatenate([grams(data, places) for data, places, _, _ in joined(run)]), return_counts=True)
                codes, counts = _summed(np.concatenate([codes, found]), np.concatenate([counts, n if chosen else np.zeros(len(n), np.int64)]))
        rows = [(g, home, _sent(c["codes"], c["counts"].astype(np.uint32)))
                for g, c in _by(_part(mixed((codes >> 8 * (DEPTH + 1 - ROOT)).astype(np.uint64)), groups), groups, codes=codes, counts=counts)]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))],
                                    ["part", "home", "a"])

    return grouped.groupBy("part").applyInArrow(work, "part int, home int, a binary")


def counted(asked: DataFrame) -> DataFrame:
    """Runs of the grams of a group: which home asks for which, the training counts, and the levels folded to ROOT - 1 bytes."""
    wide, long = pa.list_(pa.int64()), pa.int64()

    def work(table: pa.Table) -> pa.Table:
        lists = [_received(blob, np.uint32) for blob in table.column("a").to_pylist()]
        homes = table.column("home").to_numpy()
        codes, counts = _summed(np.concatenate([x for x, _ in lists]), np.concatenate([n.astype(np.int64) for _, n in lists]))
        rows = []
        for run in _runs(codes):
            low, high = codes[run][0], codes[run][-1]
            parts = [x[np.searchsorted(x, low):np.searchsorted(x, high, side="right")] for x, _ in lists]
            who = np.flatnonzero([len(x) > 0 for x in parts])
            asked_here = _packed(homes[who].astype(np.int32).tobytes(), np.array([len(parts[i]) for i in who], np.int64).tobytes(),
                                 *(np.searchsorted(codes[run], parts[i]).astype(np.uint32).tobytes() for i in who))
            on = counts[run] > 0
            folded = subtrees(codes[run][on], counts[run][on])[-1].folded()
            rows.append((asked_here, _sent(codes[run], counts[run]), *(x.tolist() for x in folded)))
        kinds = (pa.binary(), pa.binary(), wide, wide, wide, pa.list_(pa.float64()))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                                    ["asked", "grams", "keys", "zeros", "ones", "below"])

    schema = "asked binary, grams binary, keys array<long>, zeros array<long>, ones array<long>, below array<double>"
    return stored(asked.groupBy("part").applyInArrow(work, schema), "grams")


def answered(runs: DataFrame) -> DataFrame:
    """part (home) and its grams with log10 probabilities, packed."""
    spark = runs.sparkSession
    each = runs.select(F.explode(F.arrays_zip("keys", "zeros", "ones", "below")).alias("x")).select("x.*")
    sums = each.groupBy("keys").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toPandas()
    top = spark.sparkContext.broadcast(top_levels(
        *(sums[c].to_numpy(np.int64) for c in ("keys", "zeros", "ones")), sums["below"].to_numpy(np.float64)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, blob in zip(batch.column(0), batch.column(1)):
                codes, counts = _received(blob.as_py(), np.int64)
                on = counts > 0
                logs = gram_logs(codes, subtrees(codes[on], counts[on]), top.value).astype(np.float32)
                homes, _, *lists = _unpacked(asked.as_py())
                places = [np.frombuffer(x, np.uint32) for x in lists]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(homes, np.int32)), pa.array([_sent(codes[x], logs[x]) for x in places], pa.binary())], ["part", "a"])

    return runs.select("asked", "grams").mapInArrow(work, "part int, a binary")


_ASKED = "part int, home binary, uids binary, sizes binary, words binary, counts binary"
_OWN = np.dtype([("uid", np.int64), ("id", np.int64), ("null", np.int8), ("tokens", np.int64), ("known", np.int64), ("base", np.float64),
                 ("score", np.float64), ("bytes", np.int64)])
_SUM = np.dtype([("uid", np.int64), ("known", np.int64), ("base", np.float64)])


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def score_texts(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for each text, learned where `trains` holds.

    score is the log10 probability of the text and its end under context-tree weighting over its bytes; bits_per_byte its
    code length over the number of bytes and the end. The base model adds one to the counts of lower-cased words and of the end
    of a text: base_score = sum of log10((c + 1) / (N + V + 1)), with c the training count of a token, N of all and V of
    distinct ones; n_tokens includes the end, n_known counts tokens with c > 0.

    The tree has every context of up to `DEPTH` bytes that is met, with exact counts over all training texts, so it grows with the
    corpus. Texts meet in homes by a hash. A home sends each distinct gram (a byte after its context) once, packed, to the group of the
    newest `ROOT` bytes of the context; there the counts are summed, and estimates folded into shorter contexts as far as these.
    Shorter contexts, at most 65,793, are folded on the driver, and their shares broadcast. The groups answer each home for its grams.

    The at most 16,384 words that are at least one in 16,384 of the training words are broadcast: every task answers for them itself, so no
    lookup meets a frequent word. All other words of a run of texts go, packed, to the group of their hash, where the
    counts are; each of them has less than one in 16,384 of the words. The sums go, packed again, to the group of the document.

    A null text is empty: one token, the end. A null id stays null. Rows equal in id and text give a result row each. Without
    training rows N and V are 0 and all bytes are equally likely. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"), trains.alias("trains"))
    words = stored(word_counts(texts.where("trains").select("id", "text")), "counts")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    heavy = words.where(F.col("n") * HEAVY >= total).select("key", "n").toPandas()
    keys = heavy["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], heavy["n"].to_numpy(np.int64)[order]))
    parts = max(spark.sparkContext.defaultParallelism, -(-total // GROUP_WORDS))
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    least = 4 * spark.sparkContext.defaultParallelism
    grouped = homes_of(texts, max(least, -(-size // HOME_BYTES)))
    replies = answered(counted(sent_grams(grouped, max(least, -(-size // GROUP_BYTES)))))

    def score(here: pa.Table, found: pa.Table) -> pa.Table:
        ids, _, data = _home_texts(here)
        lists = [_received(blob, np.float32) for blob in found.column("a").to_pylist()]
        codes, logs = np.concatenate([x for x, _ in lists]), np.concatenate([x for _, x in lists]).astype(np.float64)
        order = np.argsort(codes)
        codes, logs = codes[order], logs[order]
        made, at = [], 0
        for run in _slices(data):
            scores = np.zeros(len(run))
            for text, places, ends, first in joined(run):
                met, inverse = np.unique(grams(text, places), return_inverse=True)
                scores[first:first + len(ends)] = np.add.reduceat(logs[np.searchsorted(codes, met)][inverse], np.concatenate([[0], ends[:-1]]))
            made.append(ask(ids[at:at + len(run)], run, scores))
            at += len(run)
        return pa.Table.from_batches(made)

    def ask(ids: list[int | None], data: list[bytes], scores: np.ndarray) -> pa.RecordBatch:
        known_keys, known_counts = shared.value
        gains = np.log10(known_counts + 1.0)
        own = np.zeros(len(ids), _OWN)
        rare: list[np.ndarray] = []
        times: list[np.ndarray] = []
        for i, (key, text) in enumerate(zip(ids, data)):
            hashed, n = np.unique(np.append(word_hashes(word_list(text)), END_WORD), return_counts=True)
            at = np.searchsorted(known_keys, hashed)
            at[at == len(known_keys)] = 0
            hit = known_keys[at] == hashed if len(known_keys) else np.zeros(len(hashed), bool)
            own[i] = (_uid(key, text), key or 0, key is None, n.sum(), n[hit].sum(), (n[hit] * gains[at[hit]]).sum(), scores[i], len(text) + 1)
            rare.append(hashed[~hit])
            times.append(n[~hit])
        sizes = np.fromiter(map(len, rare), np.int64, len(rare))
        asked, count = np.concatenate(rare), np.concatenate(times).astype(np.uint32)
        owner = np.repeat(np.arange(len(rare)), sizes)
        part = _part(asked, parts)
        order = np.lexsort((owner, part))
        asked, count, owner, part = asked[order], count[order], owner[order], part[order]
        bounds = np.searchsorted(part, np.arange(parts + 1))
        home = np.arange(len(ids)) % parts
        rows = []
        for p in range(parts):
            mine = slice(bounds[p], bounds[p + 1])
            docs_here, n = np.unique(owner[mine], return_counts=True)
            at_home = own[home == p]
            if len(docs_here) or len(at_home):
                rows.append((p, at_home.tobytes(), own["uid"][docs_here].tobytes(), n.astype(np.uint32).tobytes(),
                             asked[mine].tobytes(), count[mine].tobytes()))
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                                          ["part", "home", "uids", "sizes", "words", "counts"])

    def answer(asked: pa.Table, found: pa.Table) -> pa.Table:
        """The sums over the words of this group, and the records sent along, by the group of the document."""
        hashes = found.column("key").to_numpy().view(np.uint64) if found.num_rows else np.empty(0, np.uint64)
        order = np.argsort(hashes)
        hashes, n = hashes[order], (found.column("n").to_numpy()[order] if found.num_rows else np.empty(0, np.int64))
        own, sums = [np.empty(0, _OWN)], [np.empty(0, _SUM)]
        for row in asked.select(["home", "uids", "sizes", "words", "counts"]).to_pylist():
            own.append(np.frombuffer(row["home"], _OWN))
            uids = np.frombuffer(row["uids"], np.int64)
            if not len(uids):
                continue
            words_here, times = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["counts"], np.uint32).astype(np.int64)
            seen = np.zeros(len(words_here), np.int64)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, words_here), len(hashes) - 1)
                seen = np.where(hashes[at] == words_here, n[at], 0)
            starts = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.uint32).astype(np.int64))[:-1]])
            made = np.zeros(len(uids), _SUM)
            made["uid"], made["base"] = uids, np.add.reduceat(times * np.log10(seen + 1.0), starts)
            made["known"] = np.add.reduceat(times * (seen > 0), starts)
            sums.append(made)
        records, totals = np.concatenate(own), np.concatenate(sums)
        homes = [_part(x["uid"].view(np.uint64), parts) for x in (records, totals)]
        rows = [(int(h), records[homes[0] == h].tobytes(), totals[homes[1] == h].tobytes()) for h in np.union1d(*homes)]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))],
                                    ["part", "records", "sums"])

    def gather(table: pa.Table) -> pa.Table:
        """A row for each record, with the sums of all groups."""
        records, totals = (np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()])
                           for c, kind in (("records", _OWN), ("sums", _SUM)))
        uids, first, times = np.unique(records["uid"], return_index=True, return_counts=True)
        at = np.searchsorted(uids, totals["uid"])
        one = records[first]
        # Rows that repeat have asked as often as they are.
        known = one["known"] + (np.bincount(at, totals["known"], len(uids)) / times).round().astype(np.int64)
        base = one["base"] + np.bincount(at, totals["base"], len(uids)) / times
        one, known, base = (np.repeat(x, times) for x in (one, known, base))
        return pa.Table.from_arrays(
            [pa.array(one["id"], mask=one["null"] != 0), *map(pa.array, (one["tokens"], known, base, one["score"], one["bytes"]))],
            ["id", "tokens", "known", "base", "score", "bytes"])

    asked = grouped.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(score, _ASKED)
    rare_words = words.where(F.col("n") * HEAVY < total).select(
        F.shiftright(F.shiftrightunsigned("key", 32) * parts, 32).cast("int").alias("part"), "key", "n")
    answers = asked.groupBy("part").cogroup(rare_words.groupBy("part")).applyInArrow(answer, "part int, records binary, sums binary")
    scored = answers.groupBy("part").applyInArrow(gather, "id long, tokens long, known long, base double, score double, bytes long")
    return scored.select(
        F.col("id").alias(id_col), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("tokens") * float(np.log10(total + distinct + 1.0))).alias("base_score"), "score",
        (-F.col("score") / float(np.log10(2)) / F.col("bytes")).alias("bits_per_byte"))
