"""String expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import fixed_values as fv

# Unicode white space and the four ASCII separators: what a stripped line loses at its ends.
_SPACES = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CLASS = f"[{_SPACES}]"
SPACE_CHARACTERS = "".join(chr(c) for c in range(0x3001) if re.match(SPACE_CLASS, chr(c)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it as a lambda variable.

    An outer expression that is used inside a lambda is evaluated again for every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE_CLASS}+", " "))


def remove_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE_CLASS}+", "")


def remove_punctuation(text: Column) -> Column:
    return F.translate(text, fv.ASCII_PUNCTUATION, "")


def words(text: Column) -> Column:
    """Space-separated words; no words for blank text."""
    return F.array_remove(F.split(text, f"{SPACE_CLASS}+"), "")


def render(template: str, **columns: Column) -> Column:
    """Concatenate a template such as `"a {{ x }} b"`; a null value renders as the empty string."""
    pieces = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    parts = []
    for position, piece in enumerate(pieces):
        if position % 2:
            parts.append(F.coalesce(columns[piece].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def char_from_code(code: Column) -> Column:
    """Character of a code point in the basic plane."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def split_passage(text: Column) -> Column:
    """Sentences of a passage: cut at the space after `.`, `?` or `!`; the space is dropped."""
    return F.split(F.regexp_replace(text, "([.?!]) ", "$1\u0001"), "\u0001")


def split_sentences(text: Column, letters: str = "가-힣") -> Column:
    """Loose sentence split at three letters plus closing marks before a space or the end.

    Every piece, the unmatched remainder included, is kept if it has more than one character, and stripped. A match
    starts on the line of its closing mark and holds at least one character before the three letters. The pattern
    looks only at the closing mark, which keeps the scan linear on text without any.
    """
    closing = rf"(?d)([^\n][{letters}]{{3}}[.?!]+)( +|$)"
    pieces = F.split(F.regexp_replace(text, closing, "$1\u0002\u0001$2\u0001"), "\u0001")

    def cut_earlier_lines(piece: Column) -> Column:
        sentence = F.regexp_replace(F.rtrim(piece, F.lit("\u0002")), "^([\\s\\S]*\n)", "$1\u0001")
        return F.when(piece.endswith("\u0002"), F.split(sentence, "\u0001")).otherwise(F.array(piece))

    return F.transform(
        F.filter(F.flatten(F.transform(pieces, cut_earlier_lines)), lambda piece: F.length(piece) > 1), strip
    )


def numbered_sentences(text: Column, letters: str = "가-힣") -> Column:
    return F.transform(
        split_sentences(text, letters), lambda sentence, i: F.concat(i.cast("string"), F.lit(" // "), sentence)
    )


def normalize_reading_answer(text: Column) -> Column:
    """Lower case, ASCII punctuation removed, spaces collapsed; the other quote characters survive."""
    return collapse_spaces(remove_punctuation(F.regexp_replace(F.lower(text), fv.READING_QUOTE_PATTERN, " ")))


def normalize_question_answer(text: Column) -> Column:
    """Quotes and brackets become spaces, then lower case, ASCII punctuation removed, spaces collapsed."""
    spaced = F.translate(text, fv.QUOTE_CHARACTERS, " " * len(fv.QUOTE_CHARACTERS))
    return collapse_spaces(remove_punctuation(F.lower(spaced)))


def normalize_squad_answer(text: Column) -> Column:
    """Lower case, ASCII punctuation and English articles removed, spaces collapsed."""
    return collapse_spaces(F.regexp_replace(remove_punctuation(F.lower(text)), r"(?U)\b(a|an|the)\b", " "))
