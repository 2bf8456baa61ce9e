"""Sequence comparisons that need a dynamic program: small per-row helpers for Arrow batches.

Each helper looks at one prediction and one reference. Spark partitions the rows; nothing here crosses rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import numpy as np


def ngram_counts(predicted: np.ndarray, reference: np.ndarray, order: int) -> list[tuple[int, int, int]]:
    """(predicted, reference, matching) n-gram totals for n = 1..order over integer sequences.

    An n-gram is identified by the rank of its prefix and its last element, so no gram text is ever built.
    """
    totals = []
    p_ids, r_ids = predicted.astype(np.int64), reference.astype(np.int64)
    p_first, r_first, base = p_ids, r_ids, 0
    for n in range(1, order + 1):
        if n > 1:
            p_ids = p_ids[:-1] * base + p_first[n - 1:]
            r_ids = r_ids[:-1] * base + r_first[n - 1:]
        both = np.concatenate([p_ids, r_ids])
        if not len(both):
            totals.extend([(0, 0, 0)] * (order - n + 1))
            break
        grams, ranks = np.unique(both, return_inverse=True)
        p_ids, r_ids = ranks[:len(p_ids)], ranks[len(p_ids):]
        if n == 1:
            p_first, r_first, base = p_ids, r_ids, len(grams)
        matching = np.minimum(
            np.bincount(p_ids, minlength=len(grams)), np.bincount(r_ids, minlength=len(grams))
        ).sum()
        totals.append((len(p_ids), len(r_ids), int(matching)))
    return totals


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def token_ids(predicted: list[str], reference: list[str]) -> tuple[np.ndarray, np.ndarray]:
    vocabulary: dict[str, int] = {}
    for token in predicted:
        vocabulary.setdefault(token, len(vocabulary))
    for token in reference:
        vocabulary.setdefault(token, len(vocabulary))
    return (np.array([vocabulary[t] for t in predicted], dtype=np.int64),
            np.array([vocabulary[t] for t in reference], dtype=np.int64))


def _lcs_rows(rows: Sequence[str], columns: Sequence[str]):
    """Yield one integer per element of `rows`; a zero bit j marks a step of the common-subsequence length at j."""
    everything = (1 << len(columns)) - 1
    places: dict[str, int] = {}
    for j, token in enumerate(columns):
        places[token] = places.get(token, 0) | (1 << j)
    state = everything
    for token in rows:
        hits = state & places.get(token, 0)
        state = ((state + hits) | (state - hits)) & everything
        yield state


def lcs_length(first: list[str], second: list[str]) -> int:
    if not first or not second:
        return 0
    state = 0
    for state in _lcs_rows(first, second):
        pass
    return len(second) - state.bit_count()


def _lcs_positions(reference: Sequence[str], candidate: Sequence[str]) -> set[int]:
    """Positions of `reference` on the traced common subsequence; on equal lengths the trace moves up."""
    table = [(1 << len(candidate)) - 1, *_lcs_rows(reference, candidate)]

    def length(i: int, j: int) -> int:
        return j - (table[i] & ((1 << j) - 1)).bit_count()

    positions, i, j = set(), len(reference), len(candidate)
    while i and j:
        if reference[i - 1] == candidate[j - 1]:
            positions.add(i - 1)
            i, j = i - 1, j - 1
        elif table[i] >> (j - 1) & 1 and length(i, j) > length(i - 1, j):
            # A set bit means that the length does not change at j, so the step to the left keeps it.
            j -= 1
        else:
            i -= 1
    return positions


class SentenceIndex:
    """The distinct sentences of a prediction, found by their tokens."""

    def __init__(self, sentences: Sequence[list[str]]) -> None:
        self.counts = Counter(t for sentence in sentences for t in sentence)
        self.sentences = list(dict.fromkeys(map(tuple, sentences)))
        self.known = set(self.sentences)
        self.holders: dict[str, list[int]] = {}
        for number, sentence in enumerate(self.sentences):
            for token in dict.fromkeys(sentence):
                self.holders.setdefault(token, []).append(number)

    def union(self, reference: list[str], used: Counter | None = None) -> Counter:
        """How often each token stands in the union of the common subsequences of a sentence with all sentences.

        A token that is `used` as often as the prediction holds it can't count more, so its places need not be found.
        Only a sentence that holds a token can add the place where it stands. So the places are taken by how many sentences hold
        their token, the fewest first, and for each the holders are traced until one covers it; most cover others too.
        """
        if tuple(reference) in self.known:
            return Counter(reference)
        covered: set[int] = set()
        traced: set[int] = set()
        used = used or Counter()
        places = [i for i, token in enumerate(reference) if token in self.holders and used[token] < self.counts[token]]
        for place in sorted(places, key=lambda i: len(self.holders[reference[i]])):
            if place in covered:
                continue
            for number in self.holders[reference[place]]:
                if number not in traced:
                    traced.add(number)
                    covered |= _lcs_positions(reference, self.sentences[number])
                    if place in covered:
                        break
        return Counter(reference[i] for i in covered)


class SuffixAutomaton:
    """The substrings of a text as an automaton of at most two states a character, made in one pass."""

    def __init__(self, text: str) -> None:
        edges, links, lengths, last = [{}], [-1], [0], 0
        for character in text:
            new = len(edges)
            edges.append({})
            lengths.append(lengths[last] + 1)
            links.append(0)
            at = last
            while at >= 0 and character not in edges[at]:
                edges[at][character] = new
                at = links[at]
            if at >= 0:
                below = edges[at][character]
                if lengths[at] + 1 == lengths[below]:
                    links[new] = below
                else:
                    # Only the shorter suffixes of this state go on with what was just added.
                    twin = len(edges)
                    edges.append(edges[below].copy())
                    lengths.append(lengths[at] + 1)
                    links.append(links[below])
                    while at >= 0 and edges[at].get(character) == below:
                        edges[at][character] = twin
                        at = links[at]
                    links[below] = links[new] = twin
            last = new
        self.edges, self.links, self.lengths = edges, links, lengths

    def longest_run(self, other: str) -> int:
        """Length of the longest contiguous text of `other` that is in the text."""
        edges, links, lengths = self.edges, self.links, self.lengths
        at = size = best = 0
        for character in other:
            while at and character not in edges[at]:
                at = links[at]
                size = lengths[at]
            to = edges[at].get(character)
            if to is not None:
                at, size = to, size + 1
                best = max(best, size)
        return best


#: Up to this length an automaton is quicker than arrays.
AUTOMATON_CHARS = 1 << 8
#: An odd factor and its inverse, so that the hash of a window doesn't depend on its place.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


#: Powers that are kept between texts.
KEPT_POWERS = 1 << 16


@lru_cache(maxsize=2)
def _kept_powers(factor: int) -> np.ndarray:
    return _new_powers(factor, KEPT_POWERS)


def _new_powers(factor: int, count: int) -> np.ndarray:
    powers = np.full(count, factor, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def _powers(factor: int, count: int) -> np.ndarray:
    return _kept_powers(factor)[:count] if count <= KEPT_POWERS else _new_powers(factor, count)


class WindowHashes:
    """Hashes of the windows of a text, of any length, from sums that are taken once."""

    def __init__(self, text: str) -> None:
        self.text, self.codes = text, code_points(text)
        spread = self.codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        spread ^= spread >> np.uint64(29)
        self.sums = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum(spread * _powers(_FACTOR, len(text) + 1)[1:], out=self.sums[1:])
        self.back = _powers(_INVERSE, len(text) + 1)

    def windows(self, length: int) -> np.ndarray:
        count = len(self.text) - length + 1
        hashes = (self.sums[length:] - self.sums[:count]) * self.back[:count]
        return (hashes ^ (hashes >> np.uint64(31))) & ~np.uint64(1)

    def longest_run(self, other: WindowHashes) -> int:
        """Length of the longest contiguous text of both.

        Windows of one length are compared by hash, and one pair is read and extended as far as it goes, so mostly two or three
        lengths are tried. Equal hashes of different texts lead to the comparison by ranks.
        """
        low, high = 0, min(len(self.text), len(other.text))
        length = (high + 1) // 2
        while low < high:
            mine, theirs = self.windows(length), other.windows(length)
            keys = np.concatenate([mine, theirs | np.uint64(1)])
            keys.sort()
            met = np.flatnonzero((keys[1:] ^ keys[:-1]) == 1)
            if len(met):
                i, j = int((mine == keys[met[0]]).argmax()), int((theirs == keys[met[0]]).argmax())
                if self.text[i:i + length] != other.text[j:j + length]:
                    return longest_common_run(self.text, other.text)
                low = length + _equal_for(self.codes[i + length:], other.codes[j + length:]) \
                    + _equal_for(self.codes[:i][::-1], other.codes[:j][::-1])
                length = low + 1
            else:
                high = length - 1
                length = (low + high + 1) // 2
        return low


def _equal_for(first: np.ndarray, second: np.ndarray) -> int:
    size = min(len(first), len(second))
    differ = first[:size] != second[:size]
    return int(differ.argmax()) if differ.any() else size


def longest_runs(text: str, others: Sequence[str | None]) -> list[int | None]:
    """For each of the other texts the length of the longest contiguous text shared with `text`, in near-linear time."""
    index = None
    runs: list[int | None] = []
    for other in others:
        if other is None or other == text:
            runs.append(None if other is None else len(text))
        elif len(text) <= AUTOMATON_CHARS:
            index = index or SuffixAutomaton(text)
            runs.append(index.longest_run(other))
        else:
            index = index or WindowHashes(text)
            runs.append(index.longest_run(WindowHashes(other)))
    return runs


def longest_common_run(first: str, second: str) -> int:
    """Length of the longest common contiguous text, in time near-linear in both lengths.

    Windows of length 1, 2, 4 … get ranks, equal windows equal ranks, as long as both texts share one. The length is
    then refined by the smaller powers of two.
    """
    if not first or not second:
        return 0
    a, b = code_points(first), code_points(second)
    split = len(a)
    text = np.concatenate([a, [0x110000], b]).astype(np.int64)

    def ranked(values: np.ndarray) -> np.ndarray:
        return np.unique(values, return_inverse=True)[1]

    def shared(ranks: np.ndarray) -> bool:
        seen = np.zeros(len(text) + 1, dtype=bool)
        seen[ranks[:split]] = True
        return bool(seen[ranks[split + 1:]].any())

    def longer(ranks: np.ndarray, length: int, tail: np.ndarray, size: int) -> np.ndarray:
        """Ranks of the windows that extend `length` by `size`."""
        count = len(text) - length - size + 1
        return ranked(ranks[:count] * (len(text) + 1) + tail[length:length + count]) if count > 0 else ranks[:0]

    levels = [ranked(text)]
    if not shared(levels[0]):
        return 0
    while True:
        size = 1 << (len(levels) - 1)
        double = longer(levels[-1], size, levels[-1], size)
        if not shared(double):
            break
        levels.append(double)
    ranks, length = levels[-1], 1 << (len(levels) - 1)
    for level in range(len(levels) - 2, -1, -1):
        extended = longer(ranks, length, levels[level], 1 << level)
        if shared(extended):
            ranks, length = extended, length + (1 << level)
    return length
