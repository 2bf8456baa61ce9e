"""Repeated passages: bytes covered by strings that a document of a smaller id also holds, by a suffix sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import batch_map, mixed, text_bytes

GRAM = 16
CHUNK = 1 << 20
GROUP_BYTES = 16 << 20
PIECES = 1 << 13
#: Pieces around one anchor that may meet in one group.
HOT = 1 << 16
#: Bytes of the texts whose anchors are counted before they are told.
TOLD_BYTES = 32 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOW32 = np.uint64(0xFFFFFFFF)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _powers(base: np.uint64, count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(count, base, np.uint64)
        if count:
            out[0] = 1
        return np.multiply.accumulate(out)


class PrefixHash:
    """Polynomial hashes modulo 2^64 of all substrings of a buffer, from one running sum."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            self.lift = _powers(_BASE, len(data) + 1)
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTES[data] * _powers(_INVERSE, len(data)), out=self.sums[1:])

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[start + length] - self.sums[start]) * self.lift[start]


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, first, last) of the anchors of the texts that lie one after the other in `data` and end at `ends`.

    The anchor of a string of `length` bytes is its 16-byte gram of the smallest hash, the first of equals, so equal strings have
    the same anchor at the same place within. first to last are the starts of the strings that have this anchor.
    """
    nothing = np.empty(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    grams = length - GRAM + 1
    if len(data) < length:
        return nothing.view(np.uint64), nothing, nothing, nothing
    hashed = mixed(PrefixHash(data)(np.arange(len(data) - GRAM + 1), GRAM))
    least = (hashed & ~_LOW32) | np.arange(len(hashed), dtype=np.uint64)
    width = 1
    while width * 2 <= grams:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < grams:
        least = np.minimum(least[:len(least) - (grams - width)], least[grams - width:])
    sizes = np.maximum(ends - starts - length + 1, 0)
    string = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    if not len(string):
        return nothing.view(np.uint64), nothing, nothing, nothing
    place = (least[string] & _LOW32).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    return hashed[place[first]], place[first], string[first], string[last]


def text_anchors(texts: list[bytes], length: int):
    """(data, owner, key, place, first, last) chunk by chunk; owner is the text's index, places count from the text's beginning."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHUNK):
            size += len(texts[stop])
            stop += 1
        ends = np.cumsum(np.fromiter(map(len, texts[at:stop]), np.int64, stop - at))
        data = np.frombuffer(b"".join(texts[at:stop]), np.uint8)
        key, place, first, last = anchors(data, ends, length)
        owner = np.searchsorted(ends, first, side="right")
        yield data, ends, at, owner, key, place, first, last
        at = stop


def suffix_order(data: np.ndarray, items: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at `items` within their groups by their first `length` bytes, and which equal the one before.

    `group` must be sorted. Suffixes are read as words of eight bytes, the first byte highest, and sorted by one word after the other,
    the last first, so nothing is compared but the bytes themselves.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    eight = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        eight |= padded[k:k + len(data) + 1] << np.uint64(56 - 8 * k)
    words = []
    for at in range(0, length, 8):
        word = eight[items + at]
        words.append(word >> np.uint64(8 * (at + 8 - length)) if at + 8 > length else word)
    order = np.lexsort([*words[::-1], group])
    equal = np.zeros(len(items), bool)
    equal[1:] = group[1:] == group[:-1]
    for word in words:
        own = word[order]
        equal[1:] &= own[1:] == own[:-1]
    return order, equal


def removable(pieces: np.ndarray, sizes: np.ndarray, keys: np.ndarray, offsets: np.ndarray, ids: np.ndarray,
              length: int) -> np.ndarray:
    """For each piece and start within it: whether a piece of a smaller id holds the same `length` bytes.

    A row of `pieces` holds `sizes` bytes, then zeros, around an anchor with the key `keys`, which begins at `offsets`; all strings in it have
    that anchor. Equal pieces are one with the smallest id first; the strings of those that share a key are then sorted.
    """
    n, width = pieces.shape
    starts = np.maximum(sizes - length + 1, 0)
    out = np.zeros((n, width - length + 1), bool)
    if not n:
        return out
    rows = np.ascontiguousarray(pieces)
    digest = np.fromiter((xxhash.xxh3_64_intdigest(r.tobytes()) for r in rows), np.uint64, n)
    order = np.lexsort((ids, offsets, sizes, digest, keys))
    same = np.zeros(n, bool)
    a, b = order[1:], order[:-1]
    same[1:] = (keys[a] == keys[b]) & (digest[a] == digest[b]) & (sizes[a] == sizes[b]) & (offsets[a] == offsets[b])
    check = np.flatnonzero(same)
    same[check] = (rows[order[check]] == rows[order[check - 1]]).all(axis=1)
    number = np.cumsum(~same) - 1
    heads = order[~same]  # the smallest id of each class
    kind = np.empty(n, np.int64)
    kind[order] = number
    # Strings of classes whose key another class with another least id has: within one id nothing is removed.
    class_keys = keys[heads]
    known, inverse = np.unique(class_keys, return_inverse=True)
    lowest, highest = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min)
    np.minimum.at(lowest, inverse, ids[heads])
    np.maximum.at(highest, inverse, ids[heads])
    several = np.flatnonzero((lowest < highest)[inverse])
    least = np.repeat(ids[heads][:, None], width - length + 1, axis=1)
    several = several[np.argsort(inverse[several], kind="stable")]
    # By whole keys, so that the prefix hashes of a few thousand pieces are in memory at a time.
    key_starts = np.flatnonzero(np.concatenate([[True], inverse[several][1:] != inverse[several][:-1]])) if len(several) else several
    cuts = [0]
    for bound in [*key_starts.tolist()[1:], len(several)]:
        if bound - cuts[-1] >= PIECES or bound == len(several):
            cuts.append(bound)
    for chunk in (several[a:b] for a, b in zip(cuts, cuts[1:]) if b > a):
        reach = starts[heads[chunk]]
        row = np.repeat(np.arange(len(chunk)), reach)
        within = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        label = inverse[chunk][row] * np.int64(width) + offsets[heads[chunk]][row] - within
        by = np.argsort(label, kind="stable")
        label = label[by]
        alike = label[1:] == label[:-1]
        keep = np.flatnonzero(np.append(alike, False) | np.append(False, alike))
        if not len(keep):
            continue
        row, within, label = row[by][keep], within[by][keep], label[keep]
        sorted_, equal = suffix_order(rows[heads[chunk]].reshape(-1), row * width + within, label, length)
        runs = np.flatnonzero(~equal)
        value = np.empty(len(row), np.int64)
        value[sorted_] = np.repeat(np.minimum.reduceat(ids[heads[chunk]][row][sorted_], runs), np.diff(np.append(runs, len(row))))
        least[chunk[row], within] = value
    out = least[kind] < ids[:, None]
    out &= np.arange(width - length + 1)[None, :] < starts[:, None]
    return out


def _gathered(data: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    at = first[:, None] + np.arange(width)
    out = data[np.minimum(at, len(data) - 1)]
    out[np.arange(width)[None, :] >= size[:, None]] = 0
    return out


def _spans(remove: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) of the bytes covered by the runs of removable starts of each row."""
    edge = np.diff(np.pad(remove.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return row, begin, end - 1 + length


def _by(target: np.ndarray, groups: int, **columns: np.ndarray):
    """(group, {name: values}) for each group that is met."""
    order = np.argsort(target, kind="stable")
    bounds = np.searchsorted(target[order], np.arange(groups + 1))
    for g in np.flatnonzero(np.diff(bounds)):
        own = order[bounds[g]:bounds[g + 1]]
        yield int(g), {name: values[own] for name, values in columns.items()}


def _group(values: np.ndarray, groups: int) -> np.ndarray:
    return ((mixed(values) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def _home(ids: np.ndarray, groups: int) -> np.ndarray:
    """The group of an id."""
    return (ids ^ (ids >> 17)) % groups


_REPLY = np.dtype([("id", np.int64), ("key", np.uint64)])
_SPAN = np.dtype([("id", np.int64), ("text", np.uint64), ("from", np.int64), ("to", np.int64)])


def _packed(*parts: bytes) -> bytes:
    """Parts as one compressed string."""
    sizes = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    raw = b"".join((sizes, *parts))
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> list[bytes]:
    raw = pa.decompress(blob[8:], int(np.frombuffer(blob[:8], np.int64)[0]), codec="zstd", asbytes=True)
    count = int(np.frombuffer(raw[:8], np.int64)[0])
    ends = np.cumsum(np.frombuffer(raw[8:8 + 8 * count], np.int64)) + 8 + 8 * count
    return [raw[a:b] for a, b in zip([8 + 8 * count, *ends[:-1]], ends)]


def _columns(rows: np.ndarray) -> bytes:
    """A table of records, packed column by column."""
    return _packed(*(np.ascontiguousarray(rows[name]).tobytes() for name in rows.dtype.names))


def _rows(pairs: list[tuple[int, bytes, bytes]], kind) -> pa.RecordBatch | pa.Table:
    groups, a, b = zip(*pairs) if pairs else ((), (), ())
    return kind.from_arrays([pa.array(groups, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["part", "a", "b"])


def _read(table: pa.Table, column: str, dtype: np.dtype) -> np.ndarray:
    """The records of all packed tables in a column."""
    parts = []
    for blob in table.column(column).to_pylist():
        if blob:
            columns = [np.frombuffer(c, dtype[name]) for c, name in zip(_unpacked(blob), dtype.names)]
            rows = np.empty(len(columns[0]), dtype)
            for name, values in zip(dtype.names, columns):
                rows[name] = values
            parts.append(rows)
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def _text_mark(text: bytes) -> int:
    """Tells apart the texts of rows that repeat an id."""
    return xxhash.xxh3_64_intdigest(text)


def _piece(width: int) -> np.dtype:
    return np.dtype([("id", np.int64), ("text", np.uint64), ("at", np.int64), ("key", np.uint64), ("offset", np.int16), ("size", np.int16),
                     ("data", np.uint8, (width,))])


_SENT = ("id", "text", "at", "offset", "size")


def _send_pieces(pieces: np.ndarray) -> bytes:
    """Pieces without the zeros after them and without the key, which their bytes give."""
    width = pieces["data"].shape[1]
    inside = np.arange(width)[None, :] < pieces["size"][:, None]
    return _packed(*(np.ascontiguousarray(pieces[name]).tobytes() for name in _SENT), pieces["data"][inside].tobytes())


def _read_pieces(table: pa.Table, column: str, width: int) -> np.ndarray:
    dtype = _piece(width)
    parts = []
    for blob in table.column(column).to_pylist():
        if blob:
            *columns, data = _unpacked(blob)
            values = {name: np.frombuffer(c, dtype[name]) for name, c in zip(_SENT, columns)}
            rows = np.zeros(len(values["id"]), dtype)
            for name in _SENT:
                rows[name] = values[name]
            rows["data"][np.arange(width)[None, :] < rows["size"][:, None]] = np.frombuffer(data, np.uint8)
            parts.append(rows)
    pieces = np.concatenate(parts) if parts else np.empty(0, dtype)
    at = np.arange(len(pieces)) * width + pieces["offset"]
    for start in range(0, len(pieces), PIECES):
        own = slice(start, start + PIECES)
        pieces["key"][own] = mixed(PrefixHash(pieces["data"][own].reshape(-1))(at[own] - start * width, GRAM))
    return pieces


def _merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching spans of a text as one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["from"], spans["text"], spans["id"]))]
    fresh = np.append(True, (spans["id"][1:] != spans["id"][:-1]) | (spans["text"][1:] != spans["text"][:-1]))
    # Starts that lie beyond all ends so far of their text; ends are lifted by text so that one running maximum serves all.
    lift = np.cumsum(fresh) * (spans["to"].max() + 1)
    reach = np.maximum.accumulate(spans["to"] + lift)
    begin = np.flatnonzero(np.append(True, spans["from"][1:] + lift[1:] > reach[:-1]))
    out = spans[begin]
    out["to"] = np.maximum.reduceat(spans["to"], begin)
    return out


def hot_anchors(texts: DataFrame, total: int, length: int, most: int) -> np.ndarray:
    """Keys, in order, of the anchors that occur `most` times in (id, binary text) rows of `total` bytes; some may occur half as often.

    A run of texts tells of the keys that it holds half as often as its part of `most`. The untold rest of a key is less than
    half of `most`, so none is missed.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        size = 0

        def told() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(keys), return_counts=True)
            # In floating point: the product may pass 64 bits.
            on = n >= most * (size / max(2 * total, 1))
            return pa.RecordBatch.from_arrays([pa.array(found[on].view(np.int64)), pa.array(n[on].astype(np.int64))], ["key", "n"])

        for batch in batches:
            for data, _, _, _, key, _, _, _ in text_anchors(batch.column(1).to_pylist(), length):
                keys.append(key)
                size += len(data)
                if size >= TOLD_BYTES:
                    yield told()
                    keys, size = [], 0
        if keys:
            yield told()

    sums = texts.mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") * 2 >= most)
    return np.sort(sums.select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64))


def single_strings(pieces: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of pieces at the starts that are left, each as a piece, and their hashes."""
    row, start = np.nonzero(left)
    width = pieces["data"].shape[1]
    out = np.zeros(len(row), pieces.dtype)
    for name in ("id", "text", "key"):
        out[name] = pieces[name][row]
    out["at"], out["offset"], out["size"] = pieces["at"][row] + start, pieces["offset"][row] - start, length
    hashes = np.empty(len(row), np.uint64)
    for at in range(0, len(row), PIECES):
        own = slice(at, at + PIECES)
        out["data"][own, :length] = pieces["data"][row[own][:, None], start[own][:, None] + np.arange(length)]
        part = np.ascontiguousarray(out["data"][own]).reshape(-1)
        hashes[own] = PrefixHash(part)(np.arange(len(part) // width) * width, length)
    return out, hashes


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, most: int = HOT) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (binary) and spans (from, to) of every row.

    A byte goes if a string of `length` bytes covers it that also begins in a document with a smaller id. Texts are UTF-8 bytes, strings
    never cross documents, overlaps count, and strings are judged on the input. n_spans counts the maximal removed runs.

    1. Each text gives its anchors (see `anchors`), one for about 18 bytes; a batch sends every distinct key once, packed, to the key's
       group. Keys that two documents of a batch hold are known to be shared at once, so a key that very many documents hold comes
       once for a batch. The groups answer which keys two batches hold.
    2. The texts, grouped by a hash of the id, meet the answers. Only around shared anchors can a string repeat: these pieces
       are compared within the group by a suffix sort (`removable`); pieces that keep a string go on to the group of their key.
    3. There the pieces of all groups are compared in the same way. An anchor that occurs more than `most` times would bring too many that
       differ, as those of a template line do: its pieces go on as single strings, those without a smaller id in the group they come
       from, each to the group of its hash.
    4. The removed spans meet the texts again; the exchange of the texts is the one of step 2.

    Group counts follow the number of bytes, so a group's memory doesn't grow with the corpus.

    A null or empty text has no bytes, a text below `length` keeps all. Rows with a null id take no part and keep all. Rows that
    repeat an id are one document; none removes bytes of the other. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(4 * spark.sparkContext.defaultParallelism, -(-total // GROUP_BYTES))
    width = 2 * length - GRAM
    hot = spark.sparkContext.broadcast(hot_anchors(texts.where("id IS NOT NULL"), total, length, most))
    packed = "part int, a binary, b binary"

    def send_keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_numpy()
        keys, owners = [], []
        for _, _, at, owner, key, _, _, _ in text_anchors(batch.column(1).to_pylist(), length):
            keys.append(key)
            owners.append(ids[at + owner])
        found = np.zeros(sum(map(len, keys)), _REPLY)
        if not len(found):
            return _rows([], pa.RecordBatch)
        found["key"], found["id"] = np.concatenate(keys), np.concatenate(owners)
        found = found[np.lexsort((found["id"], found["key"]))]
        again = np.concatenate([[False], (found["key"][1:] == found["key"][:-1])])
        fresh = ~again | np.concatenate([[True], found["id"][1:] != found["id"][:-1]])
        found, again = found[fresh], again[fresh]
        shared = again | np.append(again[1:], False)
        out = [(g, _columns(c["x"]), b"") for g, c in _by(_group(found["key"][~again], groups), groups, x=found[~again])]
        known = found[shared]
        out += [(g, b"", _columns(c["x"])) for g, c in _by(_home(known["id"], groups), groups, x=known)]
        return _rows(out, pa.RecordBatch)

    def answer_keys(table: pa.Table) -> pa.Table:
        asked, known = _read(table, "a", _REPLY), _read(table, "b", _REPLY)
        asked = asked[np.argsort(asked["key"], kind="stable")]
        same = np.concatenate([[False], asked["key"][1:] == asked["key"][:-1]]) if len(asked) else np.empty(0, bool)
        known = np.concatenate([known, asked[same | np.append(same[1:], False)]]) if len(asked) else known
        return _rows([(g, _columns(c["x"]), b"") for g, c in _by(_home(known["id"], groups), groups, x=known)], pa.Table)

    piece = _piece(width)

    def judged(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Removed spans, the pieces that keep a string, and at which starts these do."""
        sizes = pieces["size"].astype(np.int64)
        remove = removable(pieces["data"], sizes, pieces["key"], pieces["offset"].astype(np.int64), pieces["id"], length)
        row, begin, end = _spans(remove, length)
        spans = np.zeros(len(row), _SPAN)
        spans["id"], spans["text"] = pieces["id"][row], pieces["text"][row]
        spans["from"], spans["to"] = pieces["at"][row] + begin, pieces["at"][row] + end
        left = ~remove & (np.arange(width - length + 1)[None, :] < (sizes - length + 1)[:, None])
        keeps = left.any(axis=1)
        return _merged(spans), pieces[keeps], left[keeps]

    def send_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, data = batch.column(0), batch.column(1).to_pylist()
        home = _home(ids.fill_null(0).to_numpy(), groups)
        missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        out = []
        for g, c in _by(home, groups, row=np.arange(len(data))):
            own = c["row"]
            out.append((g, _packed(ids.fill_null(0).to_numpy()[own].tobytes(), missing[own].tobytes(), sizes[own].tobytes(),
                                   b"".join(data[i] for i in own)), b""))
        return _rows(out, pa.RecordBatch)

    def read_texts(table: pa.Table) -> tuple[list[int | None], list[bytes]]:
        ids, found = [], []
        for blob in table.column("a").to_pylist():
            keys, missing, sizes, data = _unpacked(blob)
            ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
            ids += [None if m else k for k, m in zip(np.frombuffer(keys, np.int64).tolist(), missing)]
            found += [data[a:b] for a, b in zip([0, *ends], ends)]
        return ids, found

    def send_pieces(here: pa.Table, answers: pa.Table) -> pa.Table:
        shared = np.unique(_read(answers, "a", _REPLY))
        if not len(shared) or not here.num_rows:
            return _rows([], pa.Table)
        all_ids, all_texts = read_texts(here)
        texts_here = [t for k, t in zip(all_ids, all_texts) if k is not None]
        ids = np.array([k for k in all_ids if k is not None], np.int64)
        wanted = mixed(shared["key"] ^ mixed(shared["id"].view(np.uint64)))
        wanted.sort()
        found = []
        for data, ends, at, owner, key, place, first, last in text_anchors(texts_here, length):
            if not len(key):
                continue
            own_ids = ids[at + owner]
            asked = mixed(key ^ mixed(own_ids.view(np.uint64)))
            hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, asked), len(wanted) - 1)] == asked)
            made = np.zeros(len(hit), piece)
            starts = np.concatenate([[0], ends[:-1]])[owner[hit]]
            digests = np.fromiter(map(_text_mark, texts_here[at:at + len(ends)]), np.uint64, len(ends))
            made["id"], made["text"], made["key"], made["at"] = own_ids[hit], digests[owner[hit]], key[hit], first[hit] - starts
            made["offset"], made["size"] = place[hit] - first[hit], last[hit] - first[hit] + length
            made["data"] = _gathered(data, first[hit], made["size"].astype(np.int64), width)
            found.append(made)
        pieces = np.concatenate(found) if found else np.zeros(0, piece)
        spans, open_, left = judged(pieces)
        many = np.isin(open_["key"], hot.value)
        strings, hashes = single_strings(open_[many], left[many], length)
        out = [(g, _send_pieces(c["x"]), b"") for g, c in _by(_group(open_["key"][~many], groups), groups, x=open_[~many])]
        out += [(g, _send_pieces(c["x"]), b"") for g, c in _by(_group(hashes, groups), groups, x=strings)]
        out += [(g, b"", _columns(c["x"])) for g, c in _by(_home(spans["id"], groups), groups, x=spans)]
        return _rows(out, pa.Table)

    def settle(table: pa.Table) -> pa.Table:
        spans, _, _ = judged(_read_pieces(table, "a", width))
        spans = np.concatenate([spans, _read(table, "b", _SPAN)])
        return _rows([(g, _columns(c["x"]), b"") for g, c in _by(_home(spans["id"], groups), groups, x=spans)], pa.Table)

    def cut(here: pa.Table, found: pa.Table) -> pa.Table:
        spans = _read(found, "a", _SPAN)
        spans = spans[np.argsort(spans["id"], kind="stable")]
        columns: list[list] = [[], [], [], [], []]
        kept_all = []
        for key, text in zip(*read_texts(here)):
            own = spans[:0]
            if key is not None and len(spans):
                own = spans[np.searchsorted(spans["id"], key, "left"):np.searchsorted(spans["id"], key, "right")]
                own = own[own["text"] == _text_mark(text)]
            marks = np.zeros(len(text) + 1, np.int32)
            np.add.at(marks, own["from"], 1)
            np.add.at(marks, own["to"], -1)
            gone = np.cumsum(marks[:-1]) > 0
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(own) else text
            columns[0].append(key)
            columns[1].append(len(text))
            columns[2].append(int(gone.sum()))
            columns[3].append(len(begin))
            columns[4].append(kept)
            kept_all.append([{"from": int(a), "to": int(b)} for a, b in zip(begin, end)])
        return pa.Table.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary()),
             pa.array(kept_all, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))],
            ["id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    keys = batch_map(texts.where("id IS NOT NULL"), send_keys, packed)
    answers = keys.groupBy("part").applyInArrow(answer_keys, packed)
    grouped = batch_map(texts, send_texts, packed)
    pieces = grouped.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(send_pieces, packed)
    spans = pieces.groupBy("part").applyInArrow(settle, packed)
    result = "id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<from: long, to: long>>"
    return grouped.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(cut, result).withColumnRenamed("id", id_col)
