"""Byte-level token ids as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv

# U+FFFD stands for undecodable bytes while decoding; U+FDD0 keeps genuine U+FFFD characters apart.
_REPLACEMENT_BYTES = "\u00ef\u00bf\u00bd"
_KEEP_BYTES = "\u00ef\u00b7\u0090"


def _plain_ids(text: Column) -> Column:
    # Reading the UTF-8 bytes as ISO-8859-1 gives one character per byte, which keeps the work linear in the text.
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.when(text == "", F.array().cast("array<int>")).otherwise(
        F.transform(F.split(latin, ""), lambda byte: F.ascii(byte) + F.lit(fv.BYTE_OFFSET))
    )


def byte_ids(text: Column, sentinels: bool = False) -> Column:
    """UTF-8 bytes + 3, without the end mark. `sentinels` turns `<extra_id_n>` into its own single id."""
    if not sentinels:
        return _plain_ids(text)
    sentinel = r"<extra_id_(0|[1-9][0-9]{0,2})>"
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s){sentinel}|.+?(?={sentinel}|\z)"), 0)
    last = fv.VOCABULARY_SIZE - fv.FIRST_SENTINEL_ID - 1

    def piece_ids(piece: Column) -> Column:
        number = F.regexp_extract(piece, rf"^{sentinel}$", 1).try_cast("int")
        return F.when(number <= last, F.array(number + F.lit(fv.FIRST_SENTINEL_ID))).otherwise(_plain_ids(piece))

    return F.when(text.contains("<extra_id_"), F.flatten(F.transform(pieces, piece_ids))).otherwise(_plain_ids(text))


def byte_encode(text: Column, max_len: int | None = None, sentinels: bool = False) -> Column:
    """Ids with the end mark; `max_len` counts the end mark."""
    ids = byte_ids(text, sentinels)
    return F.concat(truncate_ids(ids, max_len), F.array(F.lit(fv.EOS_ID)))


def truncate_ids(ids: Column, max_len: int | None) -> Column:
    """Cut ids without end mark so that they fit `max_len` together with it."""
    return ids if max_len is None else F.slice(ids, 1, max_len - 1)


def encoded_length(text: Column, max_len: int | None = None) -> Column:
    """Length of `byte_encode` without building the ids."""
    size = F.octet_length(text) + F.lit(1)
    return size if max_len is None else F.least(size, F.lit(max_len))


def pad_ids(ids: Column, length: Column) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(fv.PAD_ID), length - F.size(ids)))


def attention_mask(ids: Column, length: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), length - F.size(ids)))


def _valid_text(latin: Column) -> Column:
    """Text of UTF-8 bytes given as ISO-8859-1 characters, without the bytes that do not decode."""
    shielded = F.encode(F.replace(latin, F.lit(_REPLACEMENT_BYTES), F.lit(_KEEP_BYTES)), "ISO-8859-1")
    text = F.make_valid_utf8(shielded.cast("string"))
    return F.translate(F.replace(text, F.lit("\ufffd"), F.lit("")), "\ufdd0", "\ufffd")


def byte_decode(ids: Column, skip_special: bool = True) -> Column:
    """Text of ids; undecodable bytes are dropped.

    With `skip_special=False` sentinel ids stay as `<extra_id_n>`, while end and pad marks are removed.
    """
    def piece(token: Column) -> Column:
        byte = F.chr(token - F.lit(fv.BYTE_OFFSET))
        if skip_special:
            return byte
        name = F.concat(F.lit("<extra_id_"), (token - F.lit(fv.FIRST_SENTINEL_ID)).cast("string"), F.lit(">"))
        return F.when(token < fv.FIRST_SENTINEL_ID, byte).otherwise(name)

    upper = fv.FIRST_SENTINEL_ID if skip_special else fv.VOCABULARY_SIZE
    kept = F.filter(ids, lambda token: (token >= fv.BYTE_OFFSET) & (token < upper))
    return _valid_text(F.array_join(F.transform(kept, piece), ""))
