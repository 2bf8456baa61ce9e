"""Salient-span masking: pack sentences into contexts and mask the entities in turn."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions import fixed_values as fv
from ..functions.spans import mask_spans
from ..functions.text import let, split_passage

_CONTEXT = "array<struct<sent_no:int,sentence:string,entities:array<string>>>"


def sentence_array(text: Column) -> Column:
    """Non-empty sentences of a passage."""
    return F.filter(split_passage(text), lambda sentence: sentence != "")


def _cut(sentence: Column, max_chars: int | None) -> Column:
    return sentence if max_chars is None else F.substring(sentence, 1, max_chars)


def sentence_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", max_chars: int | None = None) -> DataFrame:
    """`key, sent_no, sentence`. `max_chars` cuts sentences for a tagger that takes no longer ones; by default they stay whole."""
    rows = docs.select(key, F.posexplode(sentence_array(F.col(text))).alias("sent_no", "sentence"))
    return rows.withColumn("sentence", _cut(F.col("sentence"), max_chars))


def pack_sentences(sentences: Column, max_bytes: int = fv.CONTEXT_MAX_BYTES) -> Column:
    """Contexts as arrays of `(sent_no, sentence)`: a sentence that would exceed `max_bytes` starts a new context.

    One pass over the sentences that records only where contexts start.
    """
    def step(state: Column, sentence: Column, number: Column) -> Column:
        size = F.octet_length(sentence)
        opens = (F.size(state["starts"]) == 0) | (state["bytes"] + size > max_bytes)
        return F.struct(
            F.when(opens, F.array_append(state["starts"], number)).otherwise(state["starts"]).alias("starts"),
            F.when(opens, size).otherwise(state["bytes"] + size).alias("bytes"))

    def contexts(numbered: Column) -> Column:
        empty = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("bytes"))
        starts = F.aggregate(numbered, empty, lambda state, s: step(state, s["sentence"], s["sent_no"]),
                             lambda state: state["starts"])
        return let(starts, lambda at: F.transform(at, lambda first, i: F.slice(
            numbered, first + 1, F.coalesce(F.get(at, i + 1), F.size(numbered)) - first)))

    numbered = F.transform(sentences, lambda s, i: F.struct(i.cast("int").alias("sent_no"), s.alias("sentence")))
    return let(numbered, contexts)


def pack_contexts(docs: DataFrame, text: str = "text", key: str = "doc_id",
                  max_bytes: int = fv.CONTEXT_MAX_BYTES) -> DataFrame:
    """`key, context_no, sentences` with the whole sentences of each context."""
    packed = docs.select(key, pack_sentences(sentence_array(F.col(text)), max_bytes).alias("_contexts"))
    return packed.select(key, F.posexplode("_contexts").alias("context_no", "sentences"))


def round_robin(entities: Column, variant: Column, variants: int) -> Column:
    """Every `variants`-th entity, beginning with number `variant`."""
    return F.filter(entities, lambda _, i: i % variants == variant)


@F.pandas_udf(StructType().add("text", StringType()).add("target", StringType()))
def _mask_each(sentences: pd.Series, entities: pd.Series, first: pd.Series, compat: pd.Series) -> pd.DataFrame:
    rows = [mask_spans(s, [list(e)], int(n), "" if c else ">")[0] for s, e, n, c in zip(sentences, entities, first, compat)]
    return pd.DataFrame(rows, columns=["text", "target"])


def mask_sentence(sentence: Column, entities: Column, first: Column, compat: bool = False) -> Column:
    """`(text, target)`: each entity's first remaining occurrence becomes the sentinel of its number, see `mask_spans`.

    Null where the sentence or the entities are null.
    """
    given = sentence.isNotNull() & entities.isNotNull()
    none = F.array().cast("array<string>")
    masked = _mask_each(F.coalesce(sentence, F.lit("")), F.coalesce(entities, none), first, F.lit(compat))
    return F.when(given, masked)


@F.pandas_udf(ArrayType(StructType().add("text", StringType()).add("label", StringType())))
def _mask_variants(sentences: pd.Series, entities: pd.Series, variants: pd.Series, compat: pd.Series) -> pd.Series:
    out = []
    for texts, found, n, short in zip(sentences, entities, variants, compat):
        numbers, parts = [0] * n, [([], []) for _ in range(n)]
        for text, each in zip(texts, found):
            chosen = [list(each[v::n]) for v in range(n)]
            for v, (masked, target) in enumerate(mask_spans(text, chosen, numbers, "" if short else ">")):
                parts[v][0].append(masked)
                parts[v][1].append(target)
                numbers[v] += len(chosen[v])
        out.append([{"text": " ".join(t), "label": " ".join(labels)} for t, labels in parts])
    return pd.Series(out, dtype=object)


def mask_contexts(contexts: DataFrame, key: str = "doc_id", variants: int = fv.MASK_VARIANTS,
                  compat: bool = False) -> DataFrame:
    """`key, context_no, variant, text, label` from contexts of `(sent_no, sentence, entities)`.

    Sentinel numbers run on through the sentences of a context. The places of the entities are found once for all variants.
    """
    none = F.array().cast("array<string>")
    masked = _mask_variants(F.transform("sentences", lambda s: F.coalesce(s["sentence"], F.lit(""))),
                            F.transform("sentences", lambda s: F.coalesce(s["entities"], none)), F.lit(variants), F.lit(compat))
    return contexts.select(key, "context_no", F.posexplode(masked).alias("variant", "_done")).select(
        key, "context_no", "variant", "_done.text", "_done.label")


def tag_contexts(contexts: DataFrame, tagger: Callable[[Column], Column], key: str = "doc_id",
                 max_chars: int | None = None) -> DataFrame:
    """Attach the entities that a Column function finds in each sentence, cut to `max_chars` if given; stays inside the row."""
    def tagged(s: Column) -> Column:
        return let(_cut(s["sentence"], max_chars), lambda cut: F.struct(
            s["sent_no"].alias("sent_no"), cut.alias("sentence"), tagger(cut).alias("entities")))

    return contexts.select(key, "context_no", F.transform("sentences", tagged).alias("sentences"))


def join_entities(contexts: DataFrame, entities: DataFrame, key: str = "doc_id", max_chars: int | None = None) -> DataFrame:
    """Attach entities from a table `(key, sent_no, ent_no, surface)`; `max_chars` cuts the sentences.

    Every group is bounded by a row of the input: the entities of one sentence, and the sentences of one context.
    """
    per_sentence = entities.groupBy(key, "sent_no").agg(
        F.sort_array(F.collect_list(F.struct("ent_no", "surface"))).alias("_found"))
    rows = contexts.select(key, "context_no", F.explode("sentences").alias("_s")).select(
        key, "context_no", F.col("_s.sent_no").alias("sent_no"),
        _cut(F.col("_s.sentence"), max_chars).alias("sentence"))
    surfaces = F.coalesce(F.transform("_found", lambda e: e["surface"]), F.array().cast("array<string>"))
    joined = rows.join(per_sentence, [key, "sent_no"], "left").withColumn("entities", surfaces)
    return joined.groupBy(key, "context_no").agg(
        F.sort_array(F.collect_list(F.struct("sent_no", "sentence", "entities"))).alias("sentences"))


def tagged_surfaces(tagged: Column) -> Column:
    """Entity surfaces, in order, of a sentence with `<word:TT>` tags."""
    return F.regexp_extract_all(tagged, F.lit("(?d)<(.+?):[A-Z][A-Z]>"), 1)
