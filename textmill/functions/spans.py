"""Places of many strings in one text, for use on Arrow rows."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import ahocorasick


def occurrences(text: str, surfaces: set[str]) -> dict[str, list[int]]:
    """Starts of every occurrence of each surface, overlapping ones too, in one pass over the text."""
    machine = ahocorasick.Automaton()
    for surface in surfaces:
        machine.add_word(surface, surface)
    starts: dict[str, list[int]] = {surface: [] for surface in surfaces}
    if surfaces:
        machine.make_automaton()
        for last, surface in machine.iter(text):
            starts[surface].append(last - len(surface) + 1)
    return starts


def mask_spans(text: str, variants: Sequence[Sequence[str | None]], first: int | Sequence[int], close: str = ">"
               ) -> list[tuple[str, str]]:
    """`(text, target)` for each list of surfaces: the first occurrence that overlaps no masked place becomes a sentinel.

    Sentinels are numbered on from `first` (one number, or one for each list). A surface that has no occurrence left, an empty one and a
    null one, which counts as empty, still take a number and appear in the target. A masked place stays masked, so a surface never looks
    again at the occurrences that it has passed: one search of the text, then a step for each occurrence.
    """
    starts = occurrences(text, {s for surfaces in variants for s in surfaces if s})
    out = []
    for v, surfaces in enumerate(variants):
        number = first if isinstance(first, int) else first[v]
        passed = dict.fromkeys(starts, 0)
        begins: list[int] = []
        spans: dict[int, tuple[int, int]] = {}
        target = []
        for surface in surfaces:
            surface = surface or ""
            target.append(f"<extra_id_{number}>{surface}")
            found = starts.get(surface, ())
            for i in range(passed.get(surface, 0), len(found)):
                at, end = found[i], found[i] + len(surface)
                after = bisect_left(begins, at)
                free = (after == len(begins) or begins[after] >= end) and (after == 0 or spans[begins[after - 1]][0] <= at)
                passed[surface] = i + 1
                if free:
                    begins.insert(after, at)
                    spans[at] = (end, number)
                    break
            number += 1
        pieces, last = [], 0
        for at in begins:
            end, mark = spans[at]
            pieces += [text[last:at], f"<extra_id_{mark}{close}"]
            last = end
        out.append(("".join([*pieces, text[last:]]), "".join(target)))
    return out
