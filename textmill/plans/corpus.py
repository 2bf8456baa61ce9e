"""Documents to a span-masked training corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from ..functions import fixed_values as fv
from ..operators.dataset import dedup_passages
from ..operators.masking import join_entities, mask_contexts, pack_contexts, tag_contexts


def salient_span_corpus(docs: DataFrame, tagger: Callable[[Column], Column] | None = None,
                        entities: DataFrame | None = None, text: str = "text", key: str = "doc_id",
                        max_bytes: int = fv.CONTEXT_MAX_BYTES, variants: int = fv.MASK_VARIANTS,
                        dedup: bool = True, compat: bool = False, max_chars: int | None = None) -> DataFrame:
    """`key, context_no, variant, text, label`.

    Entities come from a Column function over a sentence, which keeps the whole job inside the rows after
    deduplication, or from a table `(key, sent_no, ent_no, surface)`. `max_chars` cuts each sentence, as a tagger with a
    limit needs it; by default sentences stay whole.
    """
    if (tagger is None) == (entities is None):
        raise ValueError("give either a tagger or an entity table")
    distinct = dedup_passages(docs, text, key) if dedup else docs
    contexts = pack_contexts(distinct, text, key, max_bytes)
    tagged = tag_contexts(contexts, tagger, key, max_chars) if tagger else join_entities(contexts, entities, key, max_chars)
    return mask_contexts(tagged, key, variants, compat)


def write_corpus(corpus: DataFrame, path: str) -> None:
    """JSON lines with `text` and `label`."""
    corpus.select("text", "label").write.json(path)
