"""Collocations: phrases that occur more often together than their parts suggest, counted in burstable tries of word numbers."""

from __future__ import annotations

from collections import _count_elements
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import mixed, stored, text_bytes, word_hashes

LONGEST = 5
#: Tokens of a chunk, bytes of a text that are split at once, and bytes of the corpus for one prefix partition.
CHUNK, SEGMENT, PART_BYTES = 1 << 20, 4 << 20, 12 << 20
#: Entries of a trie before it spills, those of a container before it bursts, and rows counted in one go.
LIMIT, BURST, BLOCK = 1 << 18, 1 << 13, 1 << 16
#: A byte that no UTF-8 text holds stands for the end of a piece.
BREAK = b"\xff"
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", BREAK * 10)
_ENDS = b" \t.,;:!?\n\x0b\x0c\r"
_NO_RANK = 1 << 32


def tokens_of(text: bytes) -> Iterator[list[bytes]]:
    """Words of the pieces of a text, A-Z lower-cased, with BREAK between pieces; long texts come in several lists."""
    at = 0
    while at < len(text):
        end = at + SEGMENT
        while end < len(text) and text[end] not in _ENDS:
            end += 1
        yield text[at:end].lower().translate(_PIECES).replace(BREAK, b" " + BREAK + b" ").split()
        at = end


class _Numbers(dict):
    """Words numbered from 1 as they are met; BREAK is 0."""

    def __init__(self) -> None:
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def packed(columns: np.ndarray) -> bytes:
    """A table of 64-bit integers, column by column; the bytes of equal weight lie together, as most are zero or repeat."""
    columns = np.ascontiguousarray(columns, np.int64)
    planes = columns.view(np.uint8).reshape(*columns.shape, 8).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(blob: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(width, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64).reshape(width, -1)


def _joined(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(BREAK.join(words))


def _split(blob: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(blob).split(BREAK)


def _cut(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each key of an ordered array and where it is."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else keys
    for a, z in zip(first.tolist(), [*first[1:].tolist(), len(keys)]):
        yield int(keys[a]), slice(a, z)


_RUNS = "part long, chunk long, lang string, own int, run binary, ids binary"
_RUN_TYPES = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("lang", pa.string()), ("own", pa.int32()), ("run", pa.binary()), ("ids", pa.binary())])


@dataclass
class Container:
    """Counts of the rest of rows, as big-endian bytes, whose next word number is in [low, high)."""

    low: int
    high: int
    counts: dict[bytes, int] = field(default_factory=dict)


class Node:
    """A trie node: the next word number picks a child. A container serves a range of numbers, or one; a node always one."""

    def __init__(self) -> None:
        self.bounds = np.zeros(1, np.int64)
        self.children: list[Container | Node] = [Container(0, _NO_RANK)]

    def entries(self) -> int:
        return sum(c.entries() if isinstance(c, Node) else len(c.counts) for c in self.children)


class HatTrie:
    """Counts rows of `width` word numbers (0: no word) in bounded memory.

    Rows go down a shallow trie by their first words into hash tables of the rest. A container of more than `burst` entries bursts: into
    half-full ones for a part of its range of words each, or, if it serves one word, into a node for the word after it. When the trie holds more
    than `limit` entries, its largest subtrees are spilled whole, as one run in the order of their rows, until half are left.
    """

    def __init__(self, width: int, limit: int = LIMIT, burst: int = BURST) -> None:
        self.width, self.limit, self.burst = width, limit, burst
        self.root = Node()
        self.entries = 0

    def add(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Count the rows; gives the runs that are spilled meanwhile."""
        for at in range(0, len(rows), BLOCK):
            self._add(self.root, rows[at:at + BLOCK], 0)
            if self.entries > self.limit:
                sizes = np.array([self._size(c) for c in self.root.children])
                largest = np.argsort(-sizes, kind="stable")
                yield self._spilled(np.sort(largest[:1 + np.searchsorted(np.cumsum(sizes[largest]), self.entries - self.limit // 2)]))

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All that is left, as one run."""
        if self.entries:
            yield self._spilled(np.arange(len(self.root.children)))

    @staticmethod
    def _size(child: Container | Node) -> int:
        return child.entries() if isinstance(child, Node) else len(child.counts)

    def _add(self, node: Node, rows: np.ndarray, depth: int) -> None:
        which = np.searchsorted(node.bounds, rows[:, depth], "right") - 1
        order = np.argsort(which, kind="stable")
        rows, which = rows[order], which[order]
        keys = np.ascontiguousarray(rows[:, depth:].astype(">u4")).view(f"S{4 * (self.width - depth)}").reshape(-1)
        first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])).tolist()
        full = []
        for a, z in zip(first, [*first[1:], len(rows)]):
            child = node.children[which[a]]
            if isinstance(child, Node):
                self._add(child, rows[a:z], depth + 1)
                continue
            before = len(child.counts)
            _count_elements(child.counts, keys[a:z].tolist())
            self.entries += len(child.counts) - before
            if len(child.counts) > self.burst:
                full.append(child)
        for child in full:
            self._burst(node, child, depth)

    def _burst(self, node: Node, child: Container, depth: int) -> None:
        at = next(i for i, c in enumerate(node.children) if c is child)
        if child.high - child.low == 1:
            if depth + 1 < self.width:
                below = Node()
                below.children[0].counts = {k[4:]: n for k, n in child.counts.items()}
                node.children[at] = below
            return
        keys, counts = self._table(child, depth)
        words = keys.view(">u4").reshape(len(keys), -1)[:, 0].astype(np.int64)
        # Borders at quantiles, so that each part is half full, and around a word that fills a part alone.
        ordered = np.sort(words)
        cuts = ordered[np.arange(self.burst // 2, len(ordered), max(self.burst // 2, 1))]
        cuts = np.unique(np.concatenate([cuts, cuts + 1]))
        borders = [child.low, *cuts[(cuts > child.low) & (cuts < child.high)].tolist(), child.high]
        which = np.searchsorted(borders, words, "right") - 1
        order = np.argsort(which, kind="stable")
        ends = np.searchsorted(which[order], np.arange(len(borders)))
        keys, counts = keys[order].tolist(), counts[order].tolist()
        node.children[at:at + 1] = [
            Container(low, high, dict(zip(keys[a:z], counts[a:z]))) for low, high, a, z in zip(borders, borders[1:], ends.tolist(), ends[1:].tolist())]
        node.bounds = np.concatenate([node.bounds[:at], borders[:-1], node.bounds[at + 1:]]).astype(np.int64)

    def _table(self, child: Container, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of a container, padded to their full size, and their counts."""
        n = len(child.counts)
        return np.fromiter(child.counts, f"S{4 * (self.width - depth)}", n), np.fromiter(child.counts.values(), np.int64, n)

    def _spilled(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """These subtrees, in order, as one run."""
        runs = [self._spill(i) for i in places.tolist() if self._size(self.root.children[i])]
        return np.concatenate([r for r, _ in runs]), np.concatenate([n for _, n in runs])

    def _spill(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        child = self.root.children[at]
        run = self._sorted(child, int(self.root.bounds[at]), 0)
        self.entries -= len(run[0])
        high = int(self.root.bounds[at + 1]) if at + 1 < len(self.root.bounds) else _NO_RANK
        self.root.children[at] = Container(int(self.root.bounds[at]), high)
        return run

    def _sorted(self, child: Container | Node, low: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows below a child from `depth` on, in order, and their counts."""
        if isinstance(child, Container):
            keys, counts = self._table(child, depth)
            rows = keys.view(">u4").reshape(len(keys), -1).astype(np.int64)
            order = np.lexsort(rows.T[::-1])
            return rows[order], counts[order]
        parts = [self._sorted(c, int(b), depth + 1) for c, b in zip(child.children, child.bounds) if self._size(c)]
        rows = np.concatenate([r for r, _ in parts])
        return np.concatenate([np.full((len(rows), 1), low), rows], axis=1), np.concatenate([n for _, n in parts])


def encoded_chunks(docs: DataFrame, lang_col: str, text_col: str, parts: int) -> DataFrame:
    """Runs of tokens of texts of one language, and the dictionary of each as sorted runs of words.

    With part -1: chunk, lang, own (tokens of its own; up to four more follow, so that every phrase that begins in the chunk is whole)
    and the tokens as numbers of the chunk's words from 1, or 0. With a part from 0 on: the words of that part of the hashes, and for each
    its number and how many of the own tokens it is.
    """

    def rows(lang: str, words: list[bytes], whole: int, number: int) -> Iterator[pa.RecordBatch]:
        """Chunks of the first `whole` words."""
        for at in range(0, whole, CHUNK):
            part = words[at:at + CHUNK + LONGEST - 1]
            own, chunk = min(CHUNK, whole - at), number + at // CHUNK
            numbers = _Numbers()
            tokens = np.fromiter(map(numbers.__getitem__, part), np.int32, len(part))
            counts = np.bincount(tokens[:own], minlength=len(numbers))
            made = [(-1, chunk, lang, own, packed(tokens[None]), None)]
            del numbers[BREAK]
            ordered = sorted(numbers)
            place = np.fromiter(map(numbers.__getitem__, ordered), np.int64, len(ordered))
            home = (word_hashes(ordered) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            for own_part, rest in _cut(home[order]):
                named = order[rest]
                made.append((own_part, chunk, lang, own, _joined([ordered[i] for i in named.tolist()]), packed(np.stack([place[named], counts[place[named]]]))))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*made), _RUN_TYPES.types)], _RUN_TYPES.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size, number = 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = held.setdefault(lang, [])
                for words in tokens_of(text.as_py()):
                    own += words
                    size += len(words)
                    if len(own) > 2 * CHUNK:
                        # Of a long text all but the last chunk, which may go on.
                        whole = (len(own) - LONGEST) // CHUNK * CHUNK
                        yield from rows(lang, own, whole, number)
                        number += whole // CHUNK
                        del own[:whole]
                        size -= whole
                own.append(BREAK)
                size += 1
                while size >= CHUNK:
                    most = max(held, key=lambda k: len(held[k]))
                    words = held.pop(most)
                    yield from rows(most, words, len(words), number)
                    number += -(-len(words) // CHUNK)
                    size -= len(words)
        for lang, words in held.items():
            yield from rows(lang, words, len(words), number)
            number += -(-len(words) // CHUNK)

    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_bytes(text_col).alias("text"))
    return texts.mapInArrow(work, _RUNS)


def _runs(chunk: int, own: int, spilled: Iterator[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, prefix: int, parts: int) -> Iterator[dict]:
    """Runs in word ids, each cut by the partition of its first `prefix` words; order is kept, as ids rise with the numbers."""
    names = np.concatenate([[0], ids])
    for rows, counts in spilled:
        words = names[rows]
        code = np.zeros(len(words), np.uint64)
        for k in range(prefix):
            code = mixed(code ^ words[:, k].astype(np.uint64))
        part = (code % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        table = np.concatenate([words, counts[:, None]], axis=1)[order].T
        for own_part, rest in _cut(part[order]):
            yield {"part": own_part, "chunk": chunk, "own": own, "run": packed(table[:, rest])}


def merged_run(tables: list[np.ndarray]) -> np.ndarray:
    """Tables of columns of words and one of counts as one in the order of the words, each row once."""
    table = np.concatenate(tables, axis=1)
    table = table[:, np.lexsort(table[-2::-1])]
    if table.shape[1]:
        first = np.flatnonzero(np.concatenate([[True], (table[:-1, 1:] != table[:-1, :-1]).any(axis=0)]))
        table = np.concatenate([table[:-1, first], np.add.reduceat(table[-1:], first, axis=1)])
    return table


def fold_runs(batches: Iterator[pa.RecordBatch], width: int) -> np.ndarray:
    """The sum of all runs of a prefix partition. It grows with the distinct rows only: runs are merged as they come."""
    whole = np.zeros((width + 1, 0), np.int64)
    waiting: list[np.ndarray] = []
    for batch in batches:
        for blob in batch.column("run").to_pylist():
            waiting.append(unpacked(blob, width + 1))
            if sum(t.shape[1] for t in waiting) > max(whole.shape[1], LIMIT):
                whole, waiting = merged_run([whole, *waiting]), []
    return merged_run([whole, *waiting])


def frequent_prefixes(table: np.ndarray, length: int, least: int) -> np.ndarray:
    """The rows' prefixes of `length` words that occur `least` times or more, with their counts as the last column."""
    table = table[:, table[length - 1] > 0]
    if not table.shape[1]:
        return np.zeros((length + 1, 0), np.int64)
    words = table[:length]
    first = np.flatnonzero(np.concatenate([[True], (words[:, 1:] != words[:, :-1]).any(axis=0)]))
    counts = np.add.reduceat(table[-1], first)
    return np.concatenate([words[:, first], counts[None]])[:, counts >= least]


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, n): how many words each language has, and (lang, words, f): all phrases of up to five words that occur `least` times.

    Every phrase within one is as frequent, so words and then pairs that are too rare cut the texts before longer phrases are counted:

    1. Texts become chunks of up to a million tokens with a dictionary each, in sorted runs of words by partition of the word. The partitions sum
       the runs as they come and give frequent words an id; these are joined to the runs that hold them, which gives each chunk its own.
    2. Each chunk counts its pairs of frequent words in a `HatTrie`; its sorted runs go to the partition of the pair, where
       they are merged as they come. The partitions' frequent pairs are joined to the runs that hold them, which gives each chunk its own.
    3. Windows of three to five words all of whose pairs are frequent are counted in the same way, partitioned by their first three words. A
       phrase's count is the sum over the windows that begin with it.

    A chunk's memory is bounded, and a partition holds distinct phrases, not occurrences: their number grows with the corpus.
    """
    size = docs.agg(F.sum(F.octet_length(text_bytes(text_col)))).first()[0] or 0
    parts = 1 + size // PART_BYTES
    chunks = stored(encoded_chunks(docs, lang_col, text_col, parts), "chunks")

    def merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[bytes, int]] = {}
        part = 0
        for batch in batches:
            for part, lang, run, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "run", "ids"))):
                own = counts.setdefault(lang, {})
                for word, n in zip(_split(run), unpacked(ids, 2)[1].tolist()):
                    own[word] = own.get(word, 0) + n
        found = sorted((-n, lang, word) for lang, own in counts.items() for word, n in own.items() if n >= least)
        for lang, own in counts.items():
            # Ids are unique, and small for frequent words, which packs well.
            named = [(at * parts + part + 1, -n, word) for at, (n, of, word) in enumerate(found) if of == lang]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([lang]), pa.array([sum(own.values())]), pa.array([[i for i, _, _ in named]], pa.list_(pa.int64())),
                 pa.array([[n for _, n, _ in named]], pa.list_(pa.int64())), pa.array([[w for _, _, w in named]], pa.list_(pa.binary()))],
                ["part", "lang", "n", "ids", "fs", "words"])

    dictionaries = chunks.where("part >= 0").select("part", "chunk", "lang", "run", "ids")
    frequent = stored(dictionaries.groupBy("part").applyInArrow(
        merge_words, "part long, lang string, n long, ids array<long>, fs array<long>, words array<binary>"), "words")
    totals = stored(frequent.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0"), "totals")
    words = frequent.select("lang", F.inline(F.arrays_zip("ids", "fs", "words"))).toDF("lang", "id", "f", "word")

    def held_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for chunk, run, places, ids, named in zip(*(batch.column(c).to_pylist() for c in ("chunk", "run", "places", "ids", "words"))):
                known = dict(zip(named, ids))
                found = np.fromiter((known.get(w, 0) for w in _split(run)), np.int64)
                made.append((chunk, packed(np.stack([unpacked(places, 2)[0], found])[:, found > 0])))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*made), (pa.int64(), pa.binary()))], ["home", "names"])

    # Frequent words and pairs grow with the corpus, so these joins never broadcast; a part and its runs may be split.
    known = (dictionaries.withColumnRenamed("ids", "places").join(frequent.where(F.size("ids") > 0).select("part", "lang", "ids", "words").hint("merge"), ["part", "lang"])
             .mapInArrow(held_words, "home long, names binary"))

    def count_pairs(tokens: pa.Table, names: pa.Table) -> pa.Table:
        out = []
        if tokens.num_rows and names.num_rows:
            chunk, own = tokens.column("chunk")[0].as_py(), tokens.column("own")[0].as_py()
            numbers = unpacked(tokens.column("run")[0].as_py(), 1)[0]
            places, ids = np.concatenate([unpacked(b, 2) for b in names.column("names").to_pylist()], axis=1)
            order = np.argsort(ids)
            ids = ids[order]
            rank = np.zeros(max(int(numbers.max(initial=0)), int(places.max())) + 1, np.uint32)
            rank[places[order]] = np.arange(1, len(ids) + 1)
            ranked = rank[numbers]
            pairs = np.stack([ranked[:-1], ranked[1:]], axis=1)
            whole = (pairs > 0).all(axis=1)
            trie = HatTrie(2)

            def spilled() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                yield from trie.add(pairs[:own][whole[:own]])
                yield from trie.rest()
                # Those behind the own tokens are only asked for.
                after = np.unique(pairs[own:][whole[own:]], axis=0).astype(np.int64)
                yield after, np.zeros(len(after), np.int64)

            out = list(_runs(chunk, own, spilled(), ids, 2, parts))
            out.append({"part": -1, "chunk": chunk, "own": own, "run": packed(ranked[None]), "ids": packed(ids[None])})
        return pa.Table.from_pylist(out, _RUN_TYPES)

    tokens = chunks.where("part < 0").select("chunk", "own", "run")
    runs = stored(tokens.groupBy("chunk").cogroup(known.groupBy("home")).applyInArrow(count_pairs, _RUNS), "pair_runs")

    def merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches)
        part = first.column("part")[0].as_py()

        def rest() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        found = frequent_prefixes(fold_runs(rest(), 2), 2, least)
        if found.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([packed(found)])], ["part", "pairs"])

    pairs = stored(runs.where("part >= 0").groupBy("part").applyInArrow(merge_pairs, "part long, pairs binary"), "pairs")

    def held_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, found = [], []
            for chunk, run, frequent in zip(*(batch.column(c).to_pylist() for c in ("chunk", "run", "pairs"))):
                both = np.concatenate([unpacked(run, 3)[:2], unpacked(frequent, 3)[:2]], axis=1)
                both = both[:, np.lexsort(both[::-1])]
                same = (both[:, 1:] == both[:, :-1]).all(axis=0)
                if same.any():
                    asked.append(chunk)
                    found.append(packed(both[:, 1:][:, same]))
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(found, pa.binary())], ["home", "pairs"])

    replies = runs.where("part >= 0").select("part", "chunk", "run").join(pairs.hint("merge"), "part").mapInArrow(held_pairs, "home long, pairs binary")

    def count_windows(tokens: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if tokens.num_rows and answers.num_rows:
            chunk, own = tokens.column("chunk")[0].as_py(), tokens.column("own")[0].as_py()
            ranked = unpacked(tokens.column("run")[0].as_py(), 1)[0]
            ids = unpacked(tokens.column("ids")[0].as_py(), 1)[0]
            frequent = np.concatenate([unpacked(b, 2) for b in answers.column("pairs").to_pylist()], axis=1)
            codes = np.unique((np.searchsorted(ids, frequent[0]) + 1) << 32 | (np.searchsorted(ids, frequent[1]) + 1))
            joined = np.isin(ranked[:-1] << 32 | ranked[1:], codes)
            # Words from each place on, as far as each pair is frequent.
            reach = np.ones(len(ranked), np.int64)
            for k in range(1, LONGEST):
                more = np.zeros(len(ranked), bool)
                more[:len(ranked) - k] = joined[k - 1:]
                reach += (reach == k) & more
            starts = np.flatnonzero(reach[:own] >= 3)
            steps = np.arange(LONGEST)
            windows = np.where(steps < reach[starts, None], ranked[np.minimum(starts[:, None] + steps, len(ranked) - 1)], 0)
            trie = HatTrie(LONGEST)

            def spilled() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                yield from trie.add(windows)
                yield from trie.rest()

            out = list(_runs(chunk, own, spilled(), ids, 3, parts))
        return pa.Table.from_pylist(out, _RUN_TYPES)

    longer = runs.where("part < 0").groupBy("chunk").cogroup(replies.groupBy("home")).applyInArrow(count_windows, _RUNS)

    def merge_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fold_runs(batches, LONGEST)
        for length in range(3, LONGEST + 1):
            yield _phrase_rows(frequent_prefixes(table, length, least))

    phrases = stored(longer.groupBy("part").applyInArrow(merge_windows, "ids array<long>, f long")
                     .unionByName(pairs.mapInArrow(lambda batches: (_phrase_rows(unpacked(b, 3)) for batch in batches for b in batch.column("pairs").to_pylist()),
                                                   "ids array<long>, f long")), "phrases")
    spelled = phrases.select("ids", "f", F.posexplode("ids").alias("place", "id")).join(words.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("ids", "f").agg(
        F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("place", F.col("word").cast("string").alias("word")))).alias("words"))
    single = words.select("lang", F.array(F.col("word").cast("string")).alias("words"), "f")
    return totals, stored(spelled.select("lang", F.col("words.word").alias("words"), "f").unionByName(single), "spelled")


def _phrase_rows(found: np.ndarray) -> pa.RecordBatch:
    width, n = len(found) - 1, found.shape[1]
    ids = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(found[:-1].T).reshape(-1)))
    return pa.RecordBatch.from_arrays([ids, pa.array(found[-1])], ["ids", "f"])


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, most: int = 2000) -> DataFrame:
    r"""The first `most` phrases of each language: lang, rank (from 1), phrase, a, l, r, n and score.

    A text, A-Z lower-cased, is split at `[.,;:!?\x0A-\x0D]` into pieces and those into words `[^\x20\x09]+`. n counts the language's words
    and f(phrase) the phrase's contiguous occurrences within pieces, overlaps included. Candidates are phrases of two to five words
    with a = f(phrase) >= `least`. Of the cuts into two parts, with l and r the counts of the parts, the one with the
    lowest score floor(1000 * a * n / (l * r)) counts, the one with the shortest first part on ties; products are decimals of 38 digits.
    Candidates within a longer one that is as frequent are dropped: it is enough to look at those of one word more, as counts only fall
    with length. Ranks go by score and a, both descending, then by the bytes of the phrase.

    A null language counts as `und`, a null or empty text has no words, repeated rows count as often as they occur, and an empty table gives
    no rows. Long texts are cut into chunks that overlap by four tokens. Other columns are not read. Texts are taken to be valid UTF-8.
    """
    totals, found = frequent_phrases(docs, lang_col, text_col, least)
    phrase = lambda words: F.array_join(words, " ")
    known = found.select("lang", phrase(F.col("words")).alias("part"), "f")
    candidates = found.where(F.size("words") > 1).select("lang", "words", phrase(F.col("words")).alias("phrase"), F.col("f").alias("a"))
    inner = candidates.where(F.size("words") > 2).select("lang", F.col("a").alias("longer"), F.explode(F.array(
        phrase(F.slice("words", F.lit(1), F.size("words") - 1)), phrase(F.slice("words", F.lit(2), F.size("words") - 1)))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = candidates.join(inner, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 100 * a").drop("longer")
    cuts = left.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", phrase(F.slice("words", F.lit(1), F.col("k"))).alias("head"),
        phrase(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))).alias("tail"))
    cuts = (cuts.join(known.withColumnsRenamed({"part": "head", "f": "l"}), ["lang", "head"])
            .join(known.withColumnsRenamed({"part": "tail", "f": "r"}), ["lang", "tail"]).join(totals, "lang"))
    exact = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"CAST(CAST(1000 AS DECIMAL(5, 0)) * CAST(a AS DECIMAL(14, 0)) * {exact('n')} AS DECIMAL(38, 0)) div CAST({exact('l')} * {exact('r')} AS DECIMAL(38, 0))")
    scored = (cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
              .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each of some shares hold the first of all, so no task meets all candidates of a language.
    share = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    share = share.withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("place") <= most)
    ranked = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
