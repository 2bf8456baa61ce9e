"""Byte token ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import byte_ids as ids
from ..operators import tokens
from . import Registry, sql_hash, texts

QUERIES = Registry()


def _joined(column):
    return F.concat_ws(" ", F.transform(column, lambda x: x.cast("string")))


_BYTES_SQL = """list_transform(range(0, strlen(text)),
  lambda i: ('0x' || substr(hex(encode(text)), (2 * i + 1)::INT, 2))::INT + 3)"""


@QUERIES.add(f"""
SELECT conv_id, turn, array_to_string(list_append({_BYTES_SQL}, 1), ' ') AS ids FROM conversations""")
def t1_encode(spark, sf):
    return texts(spark, sf, "conversations").select(
        "conv_id", "turn", _joined(ids.byte_encode(F.col("text"))).alias("ids"))


@QUERIES.add("""
WITH pieces AS (
  SELECT item_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i
  FROM benchmark),
coded AS (SELECT item_id, i, CASE WHEN i % 10 = 0 THEN [259 + (i - 1) % 100] ELSE list_transform(
    regexp_extract_all(hex(encode(word)), '..'), lambda h: ('0x' || h)::INT + 3) END AS ids FROM pieces)
SELECT item_id, array_to_string(flatten(list(CASE WHEN i = 1 THEN ids ELSE list_prepend(35, ids) END ORDER BY i)), ' ') || ' 1' AS ids
FROM coded GROUP BY item_id""")
def t1_encode_sentinels(spark, sf):
    """Every tenth word replaced by a sentinel, which takes a single id."""
    words = F.transform(F.split("text", " ", -1), lambda w, i: F.when(
        (i + 1) % 10 == 0, F.concat(F.lit("<extra_id_"), (i % 100).cast("string"), F.lit(">"))).otherwise(w))
    encoded = texts(spark, sf, "benchmark").select(
        "item_id", ids.byte_encode(F.array_join(words, " "), sentinels=True).alias("x"))
    return encoded.select("item_id", _joined(F.col("x")).alias("ids"))


@QUERIES.add(f"""
SELECT conv_id, turn, array_to_string(list_append(({_BYTES_SQL})[1:63], 1), ' ') AS ids FROM conversations""")
def t2_truncate(spark, sf):
    return texts(spark, sf, "conversations").select(
        "conv_id", "turn", _joined(ids.byte_encode(F.col("text"), 64)).alias("ids"))


def _padded_sql(multiple: int) -> str:
    return f"""
WITH sized AS (
  SELECT item_id, item_id // 8 AS batch_id, list_append({_BYTES_SQL}, 1) AS ids,
    list_append(list_transform(range(item_id % 11), lambda x: 100), 1) AS target FROM benchmark),
longest AS (SELECT *, (ceil(max(len(ids)) OVER (PARTITION BY batch_id) / {multiple}.0) * {multiple})::BIGINT AS m,
  (ceil(max(len(target)) OVER (PARTITION BY batch_id) / {multiple}.0) * {multiple})::BIGINT AS n FROM sized)
SELECT item_id, batch_id, array_to_string(list_resize(ids, m, 0), ' ') AS input_ids,
  array_to_string(list_resize(list_transform(ids, lambda x: 1), m, 0), ' ') AS attention_mask,
  array_to_string(list_resize(target, n, 0), ' ') AS labels FROM longest"""


def _padded(spark, sf, multiple):
    rows = texts(spark, sf, "benchmark").select("item_id", F.col("text").alias("input_text"),
                                                F.repeat(F.lit("a"), F.col("item_id") % 11).alias("target_text"))
    batches = tokens.pad_batch(rows, 8, multiple=multiple, order="item_id", dense=True)
    return batches.select("item_id", "batch_id",
                          *[_joined(F.col(c)).alias(c) for c in ("input_ids", "attention_mask", "labels")])


@QUERIES.add(_padded_sql(1))
def t3_pad_batch(spark, sf):
    return _padded(spark, sf, 1)


@QUERIES.add(_padded_sql(8))
def t4_pad_to_multiple(spark, sf):
    return _padded(spark, sf, 8)


@QUERIES.add(f"""
WITH sized AS (SELECT doc_id, strlen(text) + 1 AS n, strlen(source) + 1 AS k,
    (greatest(strlen(text), strlen(source)) + 1 + 63) // 64 * 64 AS bucket FROM documents),
placed AS (SELECT *, row_number() OVER (ORDER BY bucket, {sql_hash('doc_id', 0)}, doc_id) - 1 AS place FROM sized),
b AS (SELECT *, place // greatest(1, 16384 // bucket) AS batch_id FROM placed)
SELECT doc_id, bucket::INT AS bucket, batch_id::BIGINT AS batch_id, (max(n) OVER w)::INT AS padded_input, n::INT AS n_input,
  (max(k) OVER w)::INT AS padded_target FROM b WINDOW w AS (PARTITION BY bucket, batch_id)""")
def t3_pad_by_length(spark, sf):
    """Batches of like length within a budget of ids."""
    rows = texts(spark, sf, "documents").select("doc_id", F.col("text").alias("input_text"), F.col("source").alias("target_text"))
    batches = tokens.pad_by_length(rows, 16384, order="doc_id")
    return batches.select("doc_id", "bucket", "batch_id", F.size("input_ids").alias("padded_input"),
                          F.size(F.filter("attention_mask", lambda m: m == 1)).alias("n_input"), F.size("labels").alias("padded_target"))


@QUERIES.add("SELECT doc_id, text FROM documents")
def t5_decode(spark, sf):
    """Encoding and decoding give the text back."""
    return texts(spark, sf, "documents").select("doc_id", ids.byte_decode(ids.byte_encode(F.col("text"))).alias("text"))


@QUERIES.add("""
SELECT lang, count(*) AS n_rows, max(strlen(text) + 1) AS max_length, sum(strlen(text) + 1)::BIGINT AS sum_length,
  quantile_disc(strlen(text) + 1, 0.5) AS median_length FROM documents GROUP BY lang""", ints=("max_length", "median_length"))
def t6_length_profile(spark, sf):
    profile = tokens.length_profile(texts(spark, sf, "documents"), "text", ["lang"])
    return profile.withColumn("median_length", F.col("quantiles")[0]).drop("quantiles")
