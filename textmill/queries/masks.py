"""Span-masked corpora. Capitalised words serve as entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masking
from ..plans.corpus import salient_span_corpus
from . import Registry, texts

QUERIES = Registry()
_ENTITY = "[A-Z][a-z]{3,}"

_SENTENCES_SQL = r"""
s AS (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS sent_no FROM (
  SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.?!]) ', '\1' || chr(1), 'g'), chr(1)),
    lambda x: x <> '') AS l FROM docs))"""
_PACK_SQL = """
p AS (SELECT doc_id, sent_no, 0 AS context_no, strlen(sentence) AS running FROM s WHERE sent_no = 0
  UNION ALL SELECT s.doc_id, s.sent_no,
    CASE WHEN p.running + strlen(s.sentence) > 1024 THEN p.context_no + 1 ELSE p.context_no END,
    CASE WHEN p.running + strlen(s.sentence) > 1024 THEN strlen(s.sentence) ELSE p.running + strlen(s.sentence) END
  FROM p JOIN s ON s.doc_id = p.doc_id AND s.sent_no = p.sent_no + 1)"""
_ALL = "docs AS (SELECT doc_id, text FROM documents)"
_DISTINCT = "docs AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text)"


def _masked_sql(docs: str, context: str, variants: int) -> str:
    """Sentence texts with one private-use character per masked place, and the targets."""
    return rf"""
WITH RECURSIVE {docs}, {_SENTENCES_SQL}, {_PACK_SQL},
cut AS (SELECT doc_id, sent_no, {context} AS context_no, sentence AS cut FROM s JOIN p USING (doc_id, sent_no)),
ents AS (SELECT doc_id, sent_no, context_no, unnest(e) AS surface, generate_subscripts(e, 1) - 1 AS ent_no
  FROM (SELECT *, regexp_extract_all(cut, '{_ENTITY}') AS e FROM cut)),
v AS (SELECT *, ent_no % {variants} AS variant,
    row_number() OVER (PARTITION BY doc_id, context_no, ent_no % {variants} ORDER BY sent_no, ent_no) - 1 AS number,
    row_number() OVER (PARTITION BY doc_id, sent_no, ent_no % {variants} ORDER BY ent_no) AS k FROM ents),
m AS (SELECT doc_id, sent_no, variant, 0::BIGINT AS k, cut AS text FROM cut, (SELECT unnest(range({variants})) AS variant)
  UNION ALL SELECT m.doc_id, m.sent_no, m.variant, v.k, CASE WHEN instr(m.text, surface) > 0
    THEN left(m.text, instr(m.text, surface) - 1) || chr((57344 + number)::INT)
      || substr(m.text, instr(m.text, surface) + length(surface)) ELSE m.text END
  FROM m JOIN v ON v.doc_id = m.doc_id AND v.sent_no = m.sent_no AND v.variant = m.variant AND v.k = m.k + 1),
texts AS (SELECT doc_id, sent_no, variant, arg_max(text, k) AS text FROM m GROUP BY ALL),
targets AS (SELECT doc_id, sent_no, variant,
  string_agg('<extra_id_' || number || '>' || surface, '' ORDER BY k) AS target FROM v GROUP BY ALL),
done AS (SELECT t.doc_id, cut.context_no, t.sent_no, t.variant, coalesce(target, '') AS target,
  array_to_string(list_transform(string_split(t.text, ''), lambda c: CASE WHEN unicode(c) BETWEEN 57344 AND 63743
    THEN '<extra_id_' || (unicode(c) - 57344) || '>' ELSE c END), '') AS text
  FROM texts t JOIN cut USING (doc_id, sent_no) LEFT JOIN targets g
    ON g.doc_id = t.doc_id AND g.sent_no = t.sent_no AND g.variant = t.variant)"""


_CORPUS_SQL = """
SELECT doc_id, context_no, variant, string_agg(text, ' ' ORDER BY sent_no) AS text,
  string_agg(target, ' ' ORDER BY sent_no) AS label FROM done GROUP BY ALL"""


def capitalised(sentence):
    return F.regexp_extract_all(sentence, F.lit(_ENTITY), 0)


@QUERIES.add(f"WITH {_ALL}, {_SENTENCES_SQL} SELECT doc_id, sent_no, sentence FROM s", ints=("sent_no",))
def m1_sentences(spark, sf):
    return masking.sentence_rows(texts(spark, sf, "documents"))


@QUERIES.add(f"""
WITH RECURSIVE {_ALL}, {_SENTENCES_SQL}, {_PACK_SQL}
SELECT doc_id, context_no, count(*) AS n_sentences, sum(strlen(sentence))::BIGINT AS n_bytes, min(sent_no) AS first_sentence
FROM s JOIN p USING (doc_id, sent_no) GROUP BY ALL""", ints=("n_sentences", "first_sentence"))
def m2_pack_contexts(spark, sf):
    contexts = masking.pack_contexts(texts(spark, sf, "documents"))
    size = F.aggregate("sentences", F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s["sentence"]))
    return contexts.select("doc_id", "context_no", F.size("sentences").alias("n_sentences"), size.alias("n_bytes"),
                           F.col("sentences")[0]["sent_no"].alias("first_sentence"))


@QUERIES.add(f"""
WITH {_ALL}, {_SENTENCES_SQL},
e AS (SELECT doc_id, sent_no, unnest(l) AS surface, generate_subscripts(l, 1) - 1 AS i
  FROM (SELECT *, regexp_extract_all(sentence, '{_ENTITY}') AS l FROM s))
SELECT doc_id, sent_no, i % 3 AS variant, string_agg(surface, ' ' ORDER BY i) AS surfaces FROM e GROUP BY ALL""", ints=("sent_no", "variant"))
def m3_round_robin(spark, sf):
    found = masking.sentence_rows(texts(spark, sf, "documents")).withColumn("e", capitalised(F.col("sentence")))
    each = found.select("doc_id", "sent_no", "e", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("variant"))
    chosen = each.withColumn("mine", masking.round_robin(F.col("e"), F.col("variant"), 3))
    return chosen.filter(F.size("mine") > 0).select("doc_id", "sent_no", "variant",
                                                    F.array_join("mine", " ").alias("surfaces"))


@QUERIES.add(_masked_sql(_ALL, "sent_no", 1) + " SELECT doc_id, sent_no, text, target FROM done", ints=("sent_no",))
def m4_mask_sentences(spark, sf):
    rows = masking.sentence_rows(texts(spark, sf, "documents")).withColumn("e", capitalised(F.col("sentence")))
    masked = masking.mask_sentence(F.col("sentence"), F.col("e"), F.lit(0))
    return rows.select("doc_id", "sent_no", masked.alias("m")).select("doc_id", "sent_no", "m.text", "m.target")


@QUERIES.add(_masked_sql(_DISTINCT, "context_no", 2) + _CORPUS_SQL, ints=("variant",))
def m5_masked_corpus(spark, sf):
    """Deduplicate, split, pack, mask in two variants, join the sentences of each context."""
    return salient_span_corpus(texts(spark, sf, "documents"), tagger=capitalised)


@QUERIES.add(_masked_sql(_ALL, "context_no", 2) + _CORPUS_SQL, ints=("variant",))
def m5_entity_table(spark, sf):
    """The same without deduplication, with the entities given as a table."""
    docs = texts(spark, sf, "documents")
    found = masking.sentence_rows(docs).select(
        "doc_id", "sent_no", F.posexplode(capitalised(F.col("sentence"))).alias("ent_no", "surface"))
    return salient_span_corpus(docs, entities=found, dedup=False)
