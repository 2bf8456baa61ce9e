"""Queries over the given tables, one for each operator, with equivalent SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..queries import Query
from . import bpe, centroids, chat, line_dedup, minhash, mixing, passages, phrases, quality, rules, scoring, vectors, warc
from .common import crc_remainder, table

QUERIES: dict[str, Query] = {}
WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def add(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return register


@add(rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, md5(unnest(s)) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS c FROM s UNION SELECT b, c FROM reach JOIN ways ON a = v WHERE c < b)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, min(c) AS component_id, s.doc_id = min(c) AS kept
FROM s JOIN reach ON v = s.doc_id GROUP BY s.doc_id, len(s)""")
def op1_minhash_near_dedup(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"))


@add()
def op2_quality_classifier(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held_out = crc_remainder(F.col("doc_id"), 3) == 1
    result = quality.classify(docs, labels.where(~held_out))
    return result.select("doc_id", held_out.alias("held_out"), "score", "predicted")


_LINE = r"translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@add(rf"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS p FROM t),
k AS (SELECT doc_id, l, p, {_LINE} AS k FROM e),
r AS (SELECT k, min(doc_id) AS first_id FROM k WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
d AS (SELECT k.doc_id, l, p, coalesce(r.first_id <> k.doc_id, false) AS gone FROM k LEFT JOIN r ON r.k = k.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id""")
def op5_line_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@add(r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS u FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3] AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 2 * source_size AS cap,
    (sum(source_size) OVER ()) * 150 - 100 * coalesce(sum(2 * source_size) OVER
      (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    (sum(w) OVER ()) - coalesce(sum(w) OVER
      (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws FROM s),
f AS (SELECT *, rest * w >= cap * 100 * ws AS is_full FROM o),
t AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE
    ELSE (first_value(rest) OVER (ORDER BY is_full, ws DESC) * w)::DOUBLE / (first_value(ws) OVER (ORDER BY is_full, ws DESC) * 100)::DOUBLE
    END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.*, source_size, target, whole, target - whole * source_size AS extra,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    u // (1::BIGINT << 38) AS g
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
b AS (SELECT *, min(before) OVER (PARTITION BY source, g) AS below, sum(size) OVER (PARTITION BY source, g) AS words FROM c),
m AS (
  SELECT *, whole + CASE WHEN extra <= 0 OR below >= extra AND below + words > extra THEN 0 WHEN below + words <= extra THEN 1
    WHEN before + size / 2 <= extra THEN 1 ELSE 0 END AS repeats FROM b)
SELECT doc_id, source, size, source_size, target, repeats::BIGINT AS repeats, (size * repeats)::BIGINT AS taken FROM m""")
def op6_mix_sources(spark, sf):
    return mixing.mix(table(spark, sf, "documents"))


@add()
def op8_byte_bpe(spark, sf):
    result = bpe.encode_texts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                              public_tokenizers.PATTERN, with_ids=False)
    return result.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def _escaped(column: str) -> str:
    """SQL for the escaped text."""
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for control in chat.CONTROL_STRINGS:
        out = f"replace({out}, '{control}', chr(92) || '{'l' if control[0] == '<' else 'b'}{control[1:]}')"
    return out


@add(f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.TURN_START + chat.ROLE_END + chat.TURN_END)} + length({_escaped("replace(role, chr(10), chr(92) || 'n')")})
    + length({_escaped('text')}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""")
def op3_chat_format(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, array(struct('user' AS role, '{probe}' AS content), struct('assistant' AS role, '{probe}' AS content)) AS messages")
    made = chat.format_records(turns.unionByName(extra, allowMissingColumns=True), "conv_id")
    read = made.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"),
                       chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.char_length("formatted").alias("chars"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                       F.col("chars").cast("long").alias("formatted_chars"))


@add()
def op9_quality_rules(spark, sf):
    result = rules.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return result.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@add()
def op10_lm_score(spark, sf):
    held_out = crc_remainder(F.col("doc_id"), 7) == 2
    result = scoring.score_texts(table(spark, sf, "documents"), ~held_out)
    return result.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@add(r"""
WITH d AS (SELECT doc_id, upper(to_hex(encode(coalesce(text, '')))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
p AS (SELECT doc_id, unnest(range(n - 49)) AS p FROM n WHERE n >= 50),
w AS MATERIALIZED (SELECT p.doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS k FROM p JOIN n ON n.doc_id = p.doc_id),
f AS (SELECT k, min(doc_id) AS first_id FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)),
g AS MATERIALIZED (SELECT w.doc_id, p FROM w JOIN f ON f.k = w.k WHERE first_id < w.doc_id),
b AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, true) AS fresh FROM g),
s AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM b),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM s GROUP BY doc_id, run),
o AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM r),
k AS (
  SELECT o.doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN next IS NULL THEN substr(h, 2 * z + 1) ELSE '' END, '' ORDER BY a) AS rest
  FROM o JOIN n ON n.doc_id = o.doc_id GROUP BY o.doc_id)
SELECT n.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM n LEFT JOIN k ON k.doc_id = n.doc_id""")
def op7_repeated_passages(spark, sf):
    result = passages.dedup_passages(table(spark, sf, "documents"))
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@add("""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT b, c FROM reach JOIN links ON a = v WHERE c < b),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept
FROM embeddings JOIN reach ON v = vec_id LEFT JOIN n ON n.a = vec_id GROUP BY vec_id""")
def op4_embedding_near_dedup(spark, sf):
    return vectors.near_vectors(table(spark, sf, "embeddings"))


@add(r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM t),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, w[i:i + m - 1] AS g FROM i, range(1, 6) r(m) WHERE i + m - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, g, array_to_string(g, ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
inner_ AS (
  SELECT lang, phrase, max(longer) AS longer FROM (
    SELECT lang, f AS longer, unnest([array_to_string(g[:-2], ' '), array_to_string(g[2:], ' ')]) AS phrase FROM f WHERE len(g) > 2) GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN inner_ x ON x.lang = f.lang AND x.phrase = f.phrase WHERE len(g) > 1 AND (longer IS NULL OR longer < f)),
k AS (SELECT lang, phrase, f AS a, unnest(range(1, len(g))) AS k, g FROM c),
s AS (
  SELECT k.lang, k.phrase, a, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM k
  JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.g[:k.k], ' ')
  JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.g[k.k + 1:], ' ') JOIN n ON n.lang = k.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS best FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b WHERE best = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000""".replace("g[:-2]", "g[:len(g) - 1]"))
def op11_collocations(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 5 * (i // 4)}, 5))::INT >> {15 - 5 * (i % 4)}) & 31), 1)" for i in range(32))


@add(f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS owner FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN owner IS NULL OR owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN owner IS NULL OR owner = page_id THEN NULL ELSE owner END AS refers_to FROM o""")
def op12_warc_archives(spark, sf):
    path = warc.archive_pages(table(spark, sf, "pages"))
    back = warc.read_archives(spark, path, with_payload=False)
    return back.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", warc.base32_digest(F.col("payload_sha1")).alias("payload_digest"),
                       "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def _centroid_rounds(rounds: int) -> str:
    """SQL for the assignments a0, c1, a1, and so on, each from the centroids before."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT rid, min({{'d': list_sum(list_transform(range(1, 65), lambda j: (q.v[j] - c.v[j]) * (q.v[j] - c.v[j])))::BIGINT, 'c': c.c}}) AS a
  FROM q CROSS JOIN c{i} c GROUP BY rid)""")
        steps.append(f"""c{i + 1} AS MATERIALIZED (
  WITH u AS (SELECT a.c AS c, unnest(q.v) AS x, unnest(range(1, 65)) AS j FROM a{i} JOIN q ON q.rid = a{i}.rid),
  s AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM u GROUP BY c, j),
  m AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM s GROUP BY c)
  SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m ON m.c = o.c)""")
    return ",\n".join(steps[:-1])


@add(f"""
WITH q AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), v)) - 1 AS c, v FROM q ORDER BY sha256('3:' || vec_id), v LIMIT 8),
{_centroid_rounds(10)},
t AS (SELECT a.c AS c, sum(a.d)::BIGINT AS t FROM a10 GROUP BY a.c)
SELECT vec_id, a.c::INT AS cluster, a.d AS distance, t.t AS cluster_inertia, (SELECT sum(t) FROM t)::BIGINT AS inertia,
  sha256(array_to_string(c10.v, ',')) AS centroid_sha256
FROM a10 JOIN q ON q.rid = a10.rid JOIN t ON t.c = a.c JOIN c10 ON c10.c = a.c""")
def op13_centroid_clusters(spark, sf):
    return centroids.cluster_vectors(table(spark, sf, "embeddings"))
