"""Sampling, splits, filters, label tables, deduplication and dialogue states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset, dialogue, labels
from ..sources.lines import dense_index
from ..sources.pairs import concat_sources
from . import Registry, sql_hash, table

QUERIES = Registry()
LANGUAGES = ["en", "fr", "de", "es"]


def _docs(spark, sf):
    return table(spark, sf, "documents")


@QUERIES.add(f"SELECT doc_id, n_chars FROM documents WHERE {sql_hash('doc_id', 7)} % 4 = 0")
def d1_shard_sample(spark, sf):
    return dataset.shard_sample(_docs(spark, sf), 4, 7, key="doc_id").select("doc_id", "n_chars")


@QUERIES.add(f"""
WITH ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY {sql_hash('doc_id', 7)}, doc_id) - 1 AS r, count(*) OVER () AS n
  FROM documents)
SELECT doc_id FROM ranked WHERE r >= n // 4 AND r < n * 2 // 4""")
def d1_shard_exact(spark, sf):
    return dataset.shard_sample(_docs(spark, sf).select("doc_id"), 4, 7, index=1, key="doc_id", exact=True)


@QUERIES.add("""
SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id AS id, text FROM benchmark
UNION ALL SELECT doc_id AS id, text FROM documents""")
def d2_union_all(spark, sf):
    docs = _docs(spark, sf).select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return concat_sources([docs, items, docs])


_SPLIT_SQL = f"""CASE WHEN {sql_hash('doc_id', 592821)} / 4294967296.0 < 0.1 THEN 'test'
  WHEN {sql_hash('doc_id', 395810)} / 4294967296.0 < 0.2 THEN 'validation' ELSE 'train' END"""


def _split(df):
    return dataset.train_test_split(df, 0.1, 0.2, key="doc_id")


@QUERIES.add(f"SELECT doc_id, {_SPLIT_SQL} AS split FROM documents")
def d3_split(spark, sf):
    return _split(_docs(spark, sf)).select("doc_id", "split")


@QUERIES.add(f"""
SELECT doc_id, split FROM (SELECT *, {_SPLIT_SQL} AS split FROM documents)
WHERE split = 'test' OR (strlen(text) + 1) + (strlen(source) + 1) < 2048""")
def d4_length_filter(spark, sf):
    return dataset.filter_by_length(_split(_docs(spark, sf)), 2048, ["text", "source"]).select("doc_id", "split")


@QUERIES.add(f"""
SELECT doc_id, split FROM (SELECT *, {_SPLIT_SQL} AS split FROM documents)
WHERE split = 'test' OR length(text) + length(source) < 2048""")
def d4_length_filter_chars(spark, sf):
    kept = dataset.filter_by_length(_split(_docs(spark, sf)), 2048, ["text", "source"], unit="chars")
    return kept.select("doc_id", "split")


@QUERIES.add(f"""
SELECT doc_id, {sql_hash('doc_id', 99)} AS draw FROM documents ORDER BY draw, doc_id""")
def d5_shuffle(spark, sf):
    from ..functions.hashing import hash32

    rows = _docs(spark, sf).select("doc_id", hash32(F.col("doc_id"), 99).alias("draw"))
    return dataset.shuffle_rows(rows, 99, "doc_id")


@QUERIES.add("SELECT doc_id AS row_id, source AS title, n_chars FROM documents")
def d7_restructure(spark, sf):
    return _docs(spark, sf).drop("text", "lang").withColumnsRenamed({"doc_id": "row_id", "source": "title"})


@QUERIES.add("""
WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS words FROM conversations)
SELECT conv_id, turn, words[len(words)] AS answer, len(words) - 1 AS start_idx FROM w""", ints=("start_idx",))
def d8_reduce_answers(spark, sf):
    words = F.split("text", " ", -1)
    answers = F.transform(words, lambda w, i: F.struct(w.alias("text"), i.alias("start_idx")))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", answers.alias("answers"))
    return dataset.reduce_answers(turns).select(
        "conv_id", "turn", F.col("answers.text").alias("answer"), F.col("answers.start_idx").alias("start_idx"))


@QUERIES.add(f"""
SELECT doc_id, toxic, 0 AS copy_no FROM labels UNION ALL
SELECT doc_id, toxic, 1 AS copy_no FROM labels WHERE {sql_hash('doc_id', 99)} % 2 = 0""")
def d9_rebalance(spark, sf):
    flagged = table(spark, sf, "labels").withColumn("flag", F.col("toxic") == 1)
    return dataset.rebalance(flagged, "flag", key="doc_id").select("doc_id", "toxic", "copy_no")


@QUERIES.add("SELECT doc_id, CASE quality WHEN 0 THEN 'low' ELSE 'high' END AS quality_text FROM labels")
def d10_map_labels(spark, sf):
    mapped = labels.map_labels(table(spark, sf, "labels"), "quality", {0: "low", 1: "high"}, "quality_text")
    return mapped.select("doc_id", "quality_text")


@QUERIES.add("""
SELECT p_partkey, CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS brand_id, p_brand AS brand_name,
  CAST(regexp_extract(p_brand, '[0-9]+') AS INT) >= 20 AS small_unmapped FROM part""")
def d10_map_labels_large(spark, sf):
    """A table too long for a literal map, and the flag for values without entry."""
    names = {f"Brand#{i}": i for i in range(100)}
    coded = labels.map_labels(table(spark, sf, "part"), "p_brand", names, "brand_id")
    named = labels.map_labels(coded, "brand_id", {i: n for n, i in names.items()}, "brand_name")
    flagged = labels.map_labels(named, "brand_id", {i: i for i in range(20)}, "small", unmapped="flag")
    return flagged.select("p_partkey", "brand_id", "brand_name", "small_unmapped")


@QUERIES.add("""
SELECT doc_id, list_position(['en','fr','de','es'], lang) - 1 AS lang_id, lang AS lang_name FROM documents""")
def d11_encode_class(spark, sf):
    coded = labels.encode_class(_docs(spark, sf), "lang", LANGUAGES, "lang_id")
    return labels.decode_class(coded, "lang_id", LANGUAGES, "lang_name").select("doc_id", "lang_id", "lang_name")


@QUERIES.add("SELECT doc_id, toxic FROM labels WHERE toxic = 0")
def d12_filter(spark, sf):
    return dataset.keep_rows(table(spark, sf, "labels"), F.col("toxic") == 0).select("doc_id", "toxic")


@QUERIES.add("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def d13_dedup_passages(spark, sf):
    return dataset.dedup_passages(_docs(spark, sf), key="doc_id").select("doc_id")


@QUERIES.add("""
WITH copies AS (SELECT doc_id, unnest(range(1 + doc_id % 3)) AS copy_no, text FROM documents),
beside AS (SELECT *, lag(text) OVER (ORDER BY doc_id, copy_no) AS before FROM copies)
SELECT doc_id, copy_no FROM beside WHERE before IS NULL OR before <> text""")
def d13_dedup_consecutive(spark, sf):
    """Passages repeated next to each other, once per question, reduced to one."""
    copies = _docs(spark, sf).select(
        "doc_id", "text", F.explode(F.sequence(F.lit(0), F.pmod("doc_id", F.lit(3)))).alias("copy_no"))
    placed = copies.withColumn("place", F.col("doc_id") * 4 + F.col("copy_no"))
    return dataset.dedup_consecutive(placed, order="place").select("doc_id", "copy_no")


@QUERIES.add("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents WHERE lang <> 'en'")
def s14_dense_index(spark, sf):
    """Rows left after a filter are numbered without gaps and without a global sort."""
    return dense_index(_docs(spark, sf).filter("lang <> 'en'").select("doc_id"), "doc_id")


@QUERIES.add("""
WITH running AS (
  SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER before AS label_state,
    count(*) OVER before AS history_turns, coalesce(sum(length(text)) OVER before, 0)::BIGINT AS history_chars
  FROM conversations
  WINDOW before AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, text AS sys_text, label_state,
  last_value(label_state IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_state, history_turns, history_chars
FROM running WHERE role = 'assistant'""")
def s6_dialogue_states(spark, sf):
    return dialogue.dialogue_states(table(spark, sf, "conversations"), system_role="assistant")
