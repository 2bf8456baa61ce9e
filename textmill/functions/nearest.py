"""Nearest texts of a block by edit distance: a small helper for Arrow groups.

The labels of a block form a trie, so a prefix that many share is compared once, and a subtree is left as soon as its lower bound
is beyond the best label found. Spark cuts the labels into blocks and deals the values out to them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Cells of the dynamic program that are expanded at once, and nodes a value follows to find its first label.
CELLS, BEAM = 1 << 20, 4


class LabelTrie:
    """Distinct labels in the order of their preference, as arrays over the nodes of their trie, level by level."""

    def __init__(self, labels: Sequence[str]) -> None:
        order = sorted(range(len(labels)), key=labels.__getitem__)
        codes = np.frombuffer("".join(labels[i] for i in order).encode("utf-32-le"), dtype=np.uint32)
        lengths = np.array([len(labels[i]) for i in order], dtype=np.int64)
        starts, ranks = np.cumsum(lengths) - lengths, np.array(order, dtype=np.int64)
        found, at, counts = np.unique(codes, return_inverse=True, return_counts=True)
        # The 63 most frequent characters have a bit of their own, all others share the last one.
        place = np.empty(len(found), dtype=np.int64)
        place[np.argsort(-counts, kind="stable")] = np.arange(len(found))
        self.alphabet, self.bits = found, np.uint64(1) << np.minimum(place, 63).astype(np.uint64)
        self.depth = int(lengths.max())

        def level(active: np.ndarray, first: np.ndarray, depth: int) -> dict[str, np.ndarray]:
            left = lengths[active] - depth
            return {"code": at[starts[active[first]] + depth - 1] if depth else np.zeros(1, dtype=np.int64),
                    "best": np.minimum.reduceat(ranks[active], first), "least": np.minimum.reduceat(left, first),
                    "most": np.maximum.reduceat(left, first),
                    # The shortest label of a node is the first one in order: it ends there or none does.
                    "ends": np.where(left[first] == 0, ranks[active[first]], -1)}

        active, parent = np.arange(len(order)), np.zeros(len(order), dtype=np.int64)
        levels, children = [level(active, np.zeros(1, dtype=np.int64), 0)], []
        for depth in range(1, self.depth + 1):
            longer = lengths[active] >= depth
            active, parent = active[longer], parent[longer]
            code = codes[starts[active] + depth - 1]
            new = np.ones(len(active), dtype=bool)
            new[1:] = (parent[1:] != parent[:-1]) | (code[1:] != code[:-1])
            first = np.flatnonzero(new)
            children.append(np.bincount(parent[first], minlength=len(levels[-1]["code"])))
            levels.append(level(active, first, depth))
            parent = np.cumsum(new) - 1
        children.append(np.zeros(len(levels[-1]["code"]), dtype=np.int64))

        sizes = [len(one["code"]) for one in levels]
        offsets = np.cumsum([0, *sizes])
        below = [np.zeros(size, dtype=np.uint64) for size in sizes]
        for depth in range(len(levels) - 2, -1, -1):
            inner = np.flatnonzero(children[depth])
            first = (np.cumsum(children[depth]) - children[depth])[inner]
            below[depth][inner] = np.bitwise_or.reduceat(self.bits[levels[depth + 1]["code"]] | below[depth + 1], first)
        self.code, self.best, self.least, self.most, self.ends = (
            np.concatenate([one[name].astype(np.int32) for one in levels]) for name in ("code", "best", "least", "most", "ends"))
        self.below, self.children = np.concatenate(below), np.concatenate(children).astype(np.int32)
        self.first = np.concatenate([offsets[d + 1] + np.cumsum(n) - n for d, n in enumerate(children)])

    def _search(self, values: Sequence[str], bounds: np.ndarray, beam_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """Distance and rank for values of one length; rank -1: no label within the bound."""
        size, count = len(values[0]), len(values)
        codes = np.frombuffer("".join(values).encode("utf-32-le"), dtype=np.uint32).reshape(count, size)
        texts = np.full(codes.shape, -1, dtype=np.int64)
        bits = np.zeros(codes.shape, dtype=np.uint64)
        if len(self.alphabet):
            place = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
            known = self.alphabet[place] == codes
            texts[known], bits[known] = place[known], self.bits[place[known]]
        kind = np.int16 if max(size, self.depth) < 15000 else np.int32
        steps = np.arange(size + 1, dtype=kind)
        rest = steps[::-1]
        none = np.iinfo(np.int64).max
        distance, rank = bounds.astype(np.int64), np.full(count, none)

        def note(of: np.ndarray, found: np.ndarray, ranks: np.ndarray) -> None:
            order = np.lexsort((ranks, found, of))
            of, found, ranks = of[order], found[order], ranks[order]
            head = np.ones(len(of), dtype=bool)
            head[1:] = of[1:] != of[:-1]
            of, found, ranks = of[head], found[head], ranks[head]
            better = (found < distance[of]) | ((found == distance[of]) & (ranks < rank[of]))
            distance[of[better]], rank[of[better]] = found[better], ranks[better]

        def expanded(of: np.ndarray, nodes: np.ndarray, row: np.ndarray):
            """The children that may still hold a better label: value, node, row of distances and lower bound."""
            n = self.children[nodes]
            source = np.repeat(np.arange(len(nodes)), n)
            child = self.first[nodes][source] + np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n)
            of, old = of[source], row[source]
            new = np.empty_like(old)
            new[:, 0] = old[:, 0] + 1
            np.minimum(old[:, 1:] + kind(1), old[:, :-1] + (texts[of] != self.code[child][:, None]), out=new[:, 1:], casting="unsafe")
            new -= steps
            np.minimum.accumulate(new, axis=1, out=new)
            new += steps
            end = self.ends[child] >= 0
            if end.any():
                note(of[end], new[end, -1].astype(np.int64), self.ends[child[end]])
            # What is left of the value and of a label have at most those characters in common that stand below the node.
            common = np.zeros(new.shape, dtype=kind)
            common[:, :-1] = np.cumsum((bits[of] & self.below[child][:, None] != 0)[:, ::-1], axis=1, dtype=kind)[:, ::-1]
            least, most = (np.minimum(x[child], np.iinfo(kind).max)[:, None].astype(kind) for x in (self.least, self.most))
            left = np.clip(common, least, most)
            bound = (new + np.maximum(rest, left) - np.minimum(common, left)).min(axis=1).astype(np.int64)
            go = (self.children[child] > 0) & ((bound < distance[of]) | ((bound == distance[of]) & (self.best[child] < rank[of])))
            return of[go], child[go], new[go], bound[go]

        everyone, root = np.arange(count), np.zeros(count, dtype=np.int64)
        start = np.broadcast_to(steps, (count, size + 1))
        if self.ends[0] >= 0:
            note(everyone, np.full(count, size, dtype=np.int64), self.ends[root])
        front = everyone, root, start
        while len(front[0]):
            of, nodes, row, bound = expanded(*front)
            order = np.lexsort((self.best[nodes], bound, of))
            head = np.flatnonzero(np.diff(of[order], prepend=-1))
            order = order[np.arange(len(order)) - np.repeat(head, np.diff(head, append=len(order))) < BEAM]
            front = of[order], nodes[order], row[order]
        stack = [] if beam_only else [(everyone, root, start, np.zeros(count, dtype=np.int64))]
        while stack:
            of, nodes, row, bound = stack.pop()
            go = (bound < distance[of]) | ((bound == distance[of]) & (self.best[nodes] < rank[of]))
            of, nodes, row, bound = of[go], nodes[go], row[go], bound[go]
            if len(of) > 1 and self.children[nodes].sum() * (size + 1) > CELLS:
                half = len(of) // 2
                stack += [(of[half:], nodes[half:], row[half:], bound[half:]), (of[:half], nodes[:half], row[:half], bound[:half])]
            elif len(of):
                of, nodes, row, bound = expanded(of, nodes, row)
                order = np.lexsort((self.best[nodes], bound))
                stack.append((of[order], nodes[order], row[order], bound[order]))
        return distance, np.where(rank == none, -1, rank)

    def nearest(self, values: Sequence[str], bounds: Sequence[int | None], beam_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """For each value the least distance and the place of its label, the smallest at that distance; -1 where all labels are
        farther than the bound. With `beam_only` a label found soon, perhaps not the nearest."""
        sizes = np.array([len(v) for v in values], dtype=np.int64)
        limits = np.array([max(s, self.depth) if b is None else b for s, b in zip(sizes.tolist(), bounds)], dtype=np.int64)
        distance, rank = np.zeros(len(values), dtype=np.int64), np.full(len(values), -1, dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
            chunk = max(1, CELLS // (16 * (int(sizes[same[0]]) + 1)))
            for at in range(0, len(same), chunk):
                some = same[at:at + chunk]
                distance[some], rank[some] = self._search([values[i] for i in some], limits[some], beam_only)
        return distance, rank
