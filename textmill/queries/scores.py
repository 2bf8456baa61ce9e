"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hashing import hash_bucket
from ..operators import prediction
from ..operators.metrics import answers, classification, dependency, overlap, states, tagging
from ..operators.tokens import pad_batch
from ..plans.evaluate import evaluate_task
from . import Registry, sql_hash, table, texts
from .formats import parsed_sentences
from .predictions import TYPES, _NEAREST_SQL, _TYPO_SQL, mistyped_parts

QUERIES = Registry()
EVENT_TYPES = ["click", "view", "purchase", "signup", "error"]


@QUERIES.add(f"""
SELECT round(avg((list_position({TYPES}, nearest) = list_position({TYPES}, p_type))::INT), 9) AS value, 'accuracy' AS metric
FROM ({_TYPO_SQL}) JOIN ({_NEAREST_SQL}) USING (pred)""")
def e1_accuracy(spark, sf):
    """Mistyped labels repaired, then compared by id."""
    ids = {name: i for i, name in enumerate(TYPES)}
    scored = evaluate_task("labels", mistyped_parts(spark, sf), "pred", "p_type", ids)
    return scored.withColumn("value", F.round("value", 9))


_CHANGED_SQL = """
SELECT conv_id, turn, text AS gold, array_to_string(list_filter(string_split(text, ' '),
  lambda w, i: i % 7 <> 0), ' ') AS pred FROM conversations"""


def _without_every_seventh_word(df, one_line: bool):
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(" ")) if one_line else F.col("text")
    kept = F.filter(F.split(text, " ", -1), lambda w, i: (i + 1) % 7 != 0)
    return df.withColumns({"gold": text, "pred": F.array_join(kept, " ")})


def changed_turns(spark, sf, one_line: bool = False):
    """Every seventh word is missing from the prediction."""
    rows = _without_every_seventh_word(texts(spark, sf, "conversations"), one_line)
    return rows.select("conv_id", "turn", "gold", "pred")


@QUERIES.add(f"SELECT round(avg((pred = gold)::INT), 9) AS exact_match, count(*) AS n_rows FROM ({_CHANGED_SQL})")
def e2_exact_match(spark, sf):
    return classification.exact_match(changed_turns(spark, sf)).withColumn("exact_match", F.round("exact_match", 9))


_FLIP_SQL = f"""
SELECT event_id, event_type AS gold, CASE {sql_hash('event_id', 21)} % 8 WHEN 0 THEN 'other'
  WHEN 1 THEN {EVENT_TYPES}[{sql_hash('event_id', 22)} % 5 + 1] ELSE event_type END AS pred FROM events"""


def flipped_events(spark, sf):
    key, gold = F.col("event_id"), F.col("event_type")
    names = F.array(*[F.lit(n) for n in EVENT_TYPES])
    other = F.get(names, hash_bucket(key, 5, 22).cast("int"))
    draw = hash_bucket(key, 8, 21)
    return table(spark, sf, "events").select(
        "event_id", gold.alias("gold"), F.when(draw == 0, "other").when(draw == 1, other).otherwise(gold).alias("pred"))


def _report_sql(pred: str) -> str:
    return f"""
WITH flips AS ({_FLIP_SQL}), e AS (SELECT gold, {pred} AS pred FROM flips),
c AS (SELECT g.gold AS label, (SELECT count(*) FROM e WHERE e.gold = g.gold AND e.pred = g.gold) AS tp,
  (SELECT count(*) FROM e WHERE e.gold = g.gold) AS support,
  (SELECT count(*) FROM e WHERE e.pred = g.gold) AS predicted FROM (SELECT DISTINCT gold FROM e) g),
s AS (SELECT *, tp / predicted AS p, tp / support AS r, 2.0 * tp / (support + predicted) AS f FROM c)
SELECT 'class' AS kind, label, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, support FROM s
UNION ALL SELECT 'accuracy', NULL, round(sum(tp) / sum(support), 4), round(sum(tp) / sum(support), 4),
  round(sum(tp) / sum(support), 4), sum(support)::BIGINT FROM s
UNION ALL SELECT 'macro avg', NULL, round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), sum(support)::BIGINT FROM s
UNION ALL SELECT 'weighted avg', NULL, round(sum(p * support) / sum(support), 4),
  round(sum(r * support) / sum(support), 4), round(sum(f * support) / sum(support), 4), sum(support)::BIGINT FROM s"""


@QUERIES.add(_report_sql("pred"))
def e3_report(spark, sf):
    return classification.classification_report(flipped_events(spark, sf))


@QUERIES.add(_report_sql("""CASE WHEN pred = 'other' THEN (SELECT arg_min(gold, event_id) FROM flips) ELSE pred END"""))
def e3_report_unknown_as_first(spark, sf):
    return classification.classification_report(flipped_events(spark, sf), order="event_id", compat=True).drop("first_row")


@QUERIES.add("SELECT event_type AS label, min(event_id) AS first_row FROM events GROUP BY event_type")
def e3_first_seen(spark, sf):
    return classification.first_seen(table(spark, sf, "events"), "event_type", "event_id")


_PUNCTUATION_SQL = r"""'!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~'"""
_SPACES_SQL = r"'[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'"


def _collapse_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, {_SPACES_SQL}, ' ', 'g'))"


def _reading_sql(text: str) -> str:
    return _collapse_sql(f"translate(lower({text}), {_PUNCTUATION_SQL}, '')")


@QUERIES.add(f"SELECT doc_id, {_reading_sql('text')} AS normal FROM documents")
def e4_normalize_reading(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", tx.normalize_reading_answer(F.col("text")).alias("normal"))


@QUERIES.add(f"""
SELECT doc_id, {_reading_sql("translate(text, '''\"《》<>〈〉()‘’', '            ')")} AS normal FROM documents""")
def e5_normalize_question(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", tx.normalize_question_answer(F.col("text")).alias("normal"))


_RUN_SQL = """
list_max(list_transform(range(1, length({p}) + 1), lambda i: list_max(list_transform(range(0, length({p}) - i + 2),
  lambda n: CASE WHEN contains({g}, substr({p}, i::INT, n::INT)) THEN n ELSE 0 END))))"""


def _changed_items(spark, sf, one_line: bool = False):
    rows = _without_every_seventh_word(texts(spark, sf, "benchmark"), one_line)
    return rows.select("item_id", "pred", "gold")


_ITEMS_SQL = """SELECT item_id, text AS gold, array_to_string(list_filter(string_split(text, ' '),
  lambda w, i: i % 7 <> 0), ' ') AS pred FROM benchmark"""


@QUERIES.add(f"""
WITH r AS (SELECT *, {_RUN_SQL.format(p='pred', g='gold')} AS run FROM ({_ITEMS_SQL}))
SELECT item_id, run::INT AS run, round(CASE WHEN run = 0 THEN 0 ELSE
  2 * (run / length(pred)) * (run / length(gold)) / (run / length(pred) + run / length(gold)) END, 9) AS rouge_w FROM r""")
def e6_rouge_w(spark, sf):
    pairs = _changed_items(spark, sf)
    scored = pairs.withColumn("run", answers.common_run(F.col("pred"), F.col("gold")))
    return scored.select("item_id", "run", F.round(answers.run_f(F.col("run"), F.col("pred"), F.col("gold")), 9).alias("rouge_w"))


@QUERIES.add("""
WITH r AS (SELECT doc_id, greatest(length(text) // 3, length(text) - length(text) // 3) AS run, length(text) AS n FROM documents)
SELECT doc_id, run, round(2 * (run / (n + 1)) * (run / n) / (run / (n + 1) + run / n), 9) AS rouge_w FROM r""", ints=("run",))
def e6_rouge_w_long(spark, sf):
    """Whole documents whose parts are swapped around a foreign mark, so the longer part is the longest run."""
    third = F.floor(F.length("text") / 3).cast("int")
    swapped = F.concat(F.substr(F.col("text"), third + 1), F.lit("\u2060"), F.substr(F.col("text"), F.lit(1), third))
    docs = texts(spark, sf, "documents").select("doc_id", "text", swapped.alias("pred"))
    scored = docs.withColumn("run", answers.common_run(F.col("pred"), F.col("text")))
    score = answers.run_f(F.col("run"), F.col("pred"), F.col("text"))
    return scored.select("doc_id", "run", F.round(score, 9).alias("rouge_w"))


def _golds(df):
    """Two gold answers per row: the text, and the text without its first word."""
    shorter = F.array_join(F.slice(F.split("gold", " ", -1), F.lit(2), F.size(F.split("gold", " ", -1))), " ")
    return df.withColumnRenamed("pred", "prediction").withColumn("golds", F.array("gold", shorter))


_SHORTER_SQL = "array_to_string(string_split(gold, ' ')[2:], ' ')"


@QUERIES.add(f"""
WITH n AS (SELECT item_id, {_reading_sql('pred')} AS p, unnest([{_reading_sql('gold')}, {_reading_sql(_SHORTER_SQL)}]) AS g
  FROM ({_ITEMS_SQL})),
r AS (SELECT *, {_RUN_SQL.format(p='p', g='g')} AS run FROM n),
s AS (SELECT item_id, max((p = g)::INT) AS em, max(CASE WHEN run = 0 THEN 0 ELSE
  2 * (run / length(p)) * (run / length(g)) / (run / length(p) + run / length(g)) END) AS rw FROM r GROUP BY item_id)
SELECT round(avg(em), 9) AS exact_match, round(avg(rw), 9) AS rouge, count(*) AS n_rows FROM s""")
def e7_reading_score(spark, sf):
    scored = answers.reading_score(_golds(_changed_items(spark, sf)))
    return scored.withColumns({c: F.round(c, 9) for c in ("exact_match", "rouge")})


@QUERIES.add("""
WITH b AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS g FROM documents),
p AS (SELECT doc_id, g, rtrim(substr(g, 1, length(g) // 3)) AS a, ltrim(substr(g, length(g) // 3 + 1)) AS b FROM b),
r AS (SELECT *, greatest(length(a), length(b)) AS run,
  length(ltrim(substr(g, length(g) // 3 + 1)) || '.' || rtrim(substr(g, 1, length(g) // 3))) AS n FROM p)
SELECT doc_id, 0.0::DOUBLE AS em, round(CASE WHEN run = 0 THEN 0 ELSE
  2 * (run / n) * (run / length(g)) / (run / n + run / length(g)) END, 9) AS rouge_w FROM r""")
def e7_reading_documents(spark, sf):
    """Golds as long as documents: the prediction has the parts of the letters swapped around a foreign mark."""
    letters = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    docs = texts(spark, sf, "documents").select("doc_id", letters.alias("gold"))
    third = F.floor(F.length("gold") / 3).cast("int")
    swapped = F.concat(F.substr(F.col("gold"), third + 1), F.lit("\u2060"), F.substr(F.col("gold"), F.lit(1), third))
    rows = docs.select("doc_id", swapped.alias("prediction"), F.array(F.lit("0 1 2"), F.col("gold")).alias("golds"))
    return answers.score_reading_answers(rows).select("doc_id", "em", F.round("rouge_w", 9).alias("rouge_w"))


_SQUAD_TOKENS_SQL = "list_filter(string_split({}, ' '), lambda w: w NOT IN ('a', 'an', 'the', ''))"


@QUERIES.add(f"""
WITH n AS (SELECT conv_id, turn, {_SQUAD_TOKENS_SQL.format(_reading_sql('pred'))} AS p,
  unnest([{_SQUAD_TOKENS_SQL.format(_reading_sql('gold'))}, {_SQUAD_TOKENS_SQL.format(_reading_sql(_SHORTER_SQL))}]) AS g
  FROM ({_CHANGED_SQL})),
b AS (SELECT *, list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)),
  len(list_filter(g, lambda x: x = t))))) AS same FROM n),
s AS (SELECT conv_id, turn, max((p = g)::INT) AS em,
  max(CASE WHEN same > 0 THEN 2.0 * same / (len(p) + len(g)) ELSE 0 END) AS f1 FROM b GROUP BY ALL)
SELECT round(avg(em) * 100, 7) AS exact_match, round(avg(f1) * 100, 7) AS f1, count(*) AS n_rows FROM s""")
def e8_squad(spark, sf):
    scored = answers.squad_score(_golds(changed_turns(spark, sf)))
    return scored.withColumns({c: F.round(c, 7) for c in ("exact_match", "f1")})


def _chrf_sql(rows: str, order: int, beta: float) -> str:
    def squeezed(text: str) -> str:
        return f"regexp_replace({text}, {_SPACES_SQL}, '', 'g')"

    return f"""
WITH t AS (SELECT row_number() OVER () AS id, {squeezed('pred')} AS p, {squeezed('gold')} AS g FROM ({rows})),
grams AS (
  SELECT id, n, unnest(list_transform(range(1, length(p) - n + 2), lambda i: substr(p, i::INT, n::INT))) AS gram, 1 AS cp, 0 AS cg
  FROM t, (SELECT unnest(range(1, {order + 1})) AS n)
  UNION ALL
  SELECT id, n, unnest(list_transform(range(1, length(g) - n + 2), lambda i: substr(g, i::INT, n::INT))), 0, 1
  FROM t, (SELECT unnest(range(1, {order + 1})) AS n)),
counts AS (SELECT id, n, gram, sum(cp) AS cp, sum(cg) AS cg FROM grams GROUP BY ALL),
rows AS (SELECT id, n, CASE WHEN sum(cg) > 0 THEN sum(cp) ELSE 0 END AS p, sum(cg) AS g, sum(least(cp, cg)) AS m
  FROM counts GROUP BY ALL),
orders AS (SELECT n, sum(p) AS p, sum(g) AS g, sum(m) AS m FROM rows GROUP BY n HAVING sum(p) > 0 AND sum(g) > 0),
means AS (SELECT avg(m / p) AS p, avg(m / g) AS r FROM orders)
SELECT round(100 * {1 + beta ** 2} * p * r / ({beta ** 2} * p + r), 7) AS chrf, (SELECT count(*) FROM t) AS n_rows FROM means"""


@QUERIES.add(_chrf_sql(_CHANGED_SQL, 6, 2.0))
def e9_chrf(spark, sf):
    return overlap.chrf(changed_turns(spark, sf)).withColumn("chrf", F.round("chrf", 7))


_ROUGE_WORDS_SQL = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def _rouge_n_sql(n: int, rows: str = _CHANGED_SQL, key: str = "conv_id, turn") -> str:
    def grams(side: str) -> str:
        return (f"list_transform(range(1, len({side}) - {n - 2}), "
                f"lambda i: array_to_string({side}[i:i + {n - 1}], ' '))")

    return f"""
SELECT {key}, CASE WHEN len(p) = 0 OR len(g) = 0 THEN 0 ELSE coalesce(list_sum(list_transform(list_distinct(p),
  lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t)))))
  * 2.0 / (len(p) + len(g)), 0) END AS f FROM (
  SELECT {key}, {grams('pw')} AS p, {grams('gw')} AS g FROM (
    SELECT {key}, {_ROUGE_WORDS_SQL.format('pred')} AS pw, {_ROUGE_WORDS_SQL.format('gold')} AS gw
    FROM ({rows})))"""


@QUERIES.add(f"""
SELECT round((SELECT avg(f) FROM ({_rouge_n_sql(1)})), 9) AS rouge1,
  round((SELECT avg(f) FROM ({_rouge_n_sql(2)})), 9) AS rouge2, (SELECT count(*) FROM conversations) AS n_rows""")
def e10_rouge_n(spark, sf):
    scored = overlap.rouge(changed_turns(spark, sf), types=("rouge1", "rouge2"))
    return scored.select(F.round("rouge1", 9).alias("rouge1"), F.round("rouge2", 9).alias("rouge2"), "n_rows")


def _tokens_sql(text: str) -> str:
    return f"list_filter(string_split(regexp_replace({text}, {_SPACES_SQL}, ' ', 'g'), ' '), lambda w: w <> '')"


def _lcs_sql(pairs: str) -> str:
    """Rows of the table of common subsequence lengths: `l[j + 1]` for the first i of g and the first j of p, step by step.

    A length is the greatest, up to j, of the one above and of the one above and to the left plus a match.
    """
    return f"""
WITH RECURSIVE pairs AS MATERIALIZED ({pairs}),
t AS (
  SELECT k, 0 AS i, list_transform(range(0, len(p) + 1), lambda j: 0) AS l FROM pairs
  UNION ALL
  SELECT k, i + 1, list_transform(range(1, len(c) + 1), lambda j: list_max(c[:j])) FROM (
    SELECT t.k AS k, i, list_transform(range(1, len(l) + 1), lambda j: greatest(l[j],
      CASE WHEN j > 1 AND g[i + 1] = p[j - 1] THEN l[j - 1] + 1 ELSE 0 END)) AS c
    FROM t JOIN pairs ON pairs.k = t.k WHERE i < len(g)))"""


_SHUFFLED_SQL = f"""
SELECT {{'a': conv_id, 'b': turn}} AS k, g, list_concat(g[len(g) // 3 + 1:], g[:len(g) // 3]) AS p FROM (
  SELECT conv_id, turn, list_filter({_tokens_sql('text')}, lambda w, i: i % 5 <> 0) AS g FROM conversations)"""


@QUERIES.add(f"""{_lcs_sql(_SHUFFLED_SQL)}
SELECT round(avg(CASE WHEN l[-1] = 0 THEN 0 ELSE 2.0 * l[-1] / (len(g) + len(p)) END), 9) AS rouge_l, count(*) AS n_rows
FROM t JOIN pairs ON pairs.k = t.k WHERE i = len(g)""")
def e10_rouge_l(spark, sf):
    """Words in another order: the prediction begins after a third of the words and ends with it."""
    words = F.filter(tx.words(F.col("text")), lambda w, i: (i + 1) % 5 != 0)
    third = F.floor(F.size("g") / 3).cast("int")
    turns = texts(spark, sf, "conversations").select(words.alias("g"))
    pairs = turns.select(F.array_join("g", " ").alias("gold"), F.array_join(
        F.concat(F.slice("g", third + 1, F.size("g")), F.slice("g", F.lit(1), third)), " ").alias("pred"))
    scored = overlap.rouge(pairs, tokenizer="whitespace", types=("rougeL",))
    return scored.select(F.round("rougeL", 9).alias("rouge_l"), "n_rows")


_LINES_SQL = f"""
SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_tokens_sql('x')}), lambda x: len(x) > 0) AS ls FROM conversations"""
_LINE_PAIRS_SQL = f"""
SELECT {{'a': conv_id, 'b': turn, 'g': gn, 'p': pn}} AS k, g, p FROM (
  SELECT conv_id, turn, unnest(ls) AS g, unnest(range(len(ls))) AS gn FROM ({_LINES_SQL})) JOIN (
  SELECT conv_id, turn, list_concat(x[len(x) // 2 + 1:], list_filter(x[:len(x) // 2], lambda w, i: i % 3 <> 0)) AS p, pn FROM (
    SELECT conv_id, turn, unnest(ls) AS x, unnest(range(len(ls))) AS pn FROM ({_LINES_SQL}))) USING (conv_id, turn)"""


@QUERIES.add(f"""{_lcs_sql(_LINE_PAIRS_SQL)},
b AS (
  SELECT pairs.k AS k, len(g) AS i, len(p) AS j, NULL::BIGINT AS hit FROM pairs
  UNION ALL
  SELECT k, CASE WHEN same OR NOT across THEN i - 1 ELSE i END, CASE WHEN same OR across THEN j - 1 ELSE j END, CASE WHEN same THEN i END FROM (
    SELECT b.k AS k, b.i AS i, j, g[b.i] = p[j] AS same, here.l[j] > above.l[j + 1] AS across
    FROM b JOIN pairs ON pairs.k = b.k JOIN t here ON here.k = b.k AND here.i = b.i JOIN t above ON above.k = b.k AND above.i = b.i - 1
    WHERE b.i > 0 AND j > 0)),
u AS (SELECT DISTINCT b.k.a AS c, b.k.b AS t, b.k.g AS gn, hit, g[hit] AS w FROM b JOIN pairs ON pairs.k = b.k WHERE hit IS NOT NULL),
used AS (SELECT c, t, w, count(*) AS n FROM u GROUP BY ALL),
held AS (SELECT c, t, w, count(*) AS n FROM (SELECT DISTINCT k.a AS c, k.b AS t, k.p AS pn, p FROM pairs), unnest(p) x(w) GROUP BY ALL),
hits AS (SELECT c, t, sum(least(used.n, held.n)) AS n FROM used JOIN held USING (c, t, w) GROUP BY c, t),
sizes AS (SELECT k.a AS c, k.b AS t, sum(CASE WHEN k.g = 0 THEN len(p) ELSE 0 END) + sum(CASE WHEN k.p = 0 THEN len(g) ELSE 0 END) AS n FROM pairs GROUP BY ALL)
SELECT round(sum(2.0 * hits.n / sizes.n) / (SELECT count(*) FROM conversations), 9) AS rouge_lsum, (SELECT count(*) FROM conversations) AS n_rows
FROM hits JOIN sizes USING (c, t)""")
def e10_rouge_lsum(spark, sf):
    """Each line of the prediction is one of the text with its halves swapped and words of the first left out, so lines overlap in part."""
    tokens = F.filter(F.transform(F.split("text", "\n", -1), tx.words), lambda x: F.size(x) > 0)
    half = lambda x: F.floor(F.size(x) / 2).cast("int")
    changed = F.transform("ls", lambda x: F.array_join(F.concat(
        F.slice(x, half(x) + 1, F.size(x)), F.filter(F.slice(x, F.lit(1), half(x)), lambda w, i: (i + 1) % 3 != 0)), " "))
    turns = texts(spark, sf, "conversations").select("text", tokens.alias("ls"))
    pairs = turns.select(F.col("text").alias("gold"), F.array_join(F.reverse(changed), "\n").alias("pred"))
    scored = overlap.rouge(pairs, tokenizer="whitespace", types=("rougeLsum",))
    return scored.select(F.round("rougeLsum", 9).alias("rouge_lsum"), "n_rows")


_LINES_KEPT_SQL = "list_filter(string_split(text, chr(10)), lambda x, i: i % 3 <> 0)"


def _token_count_sql(text: str) -> str:
    return f"len({_tokens_sql(text)})"


@QUERIES.add(f"""
SELECT round(avg(CASE WHEN p = 0 THEN 0 ELSE 2.0 * p / (p + g) END), 9) AS rouge_lsum, count(*) AS n_rows FROM (
  SELECT {_token_count_sql(f"array_to_string({_LINES_KEPT_SQL}, ' ')")} AS p, {_token_count_sql('text')} AS g FROM documents)""")
def e10_rouge_lsum_documents(spark, sf):
    """Two of three lines in reverse order: each finds its own line, so all its words count, whatever the order."""
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: (i + 1) % 3 != 0)
    pairs = texts(spark, sf, "documents").select(F.col("text").alias("gold"),
                                                 F.array_join(F.reverse(kept), "\n").alias("pred"))
    scored = overlap.rouge(pairs, tokenizer="whitespace", types=("rougeLsum",))
    return scored.select(F.round("rougeLsum", 9).alias("rouge_lsum"), "n_rows")


_WORDS_SQL = "SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') AS w FROM conversations"
_PRED_TAGS_SQL = """list_filter(list_transform(w, lambda x, i: {'w': x, 't': CASE WHEN i % 8 = 0 THEN 'OG' WHEN i % 4 = 0
  THEN 'PS' WHEN i % 6 = 0 THEN 'LC' END, 'i': i}), lambda e: e.t IS NOT NULL)"""
_GOLD_TAGS_SQL = """list_transform(list_filter(list_transform(w, lambda x, i: {'w': x, 'i': i}), lambda e: e.i % 4 = 0),
  lambda e: {'w': e.w, 't': 'PS'})"""


_TAGGED_SQL = f"""SELECT * EXCLUDE (w), array_to_string(list_transform(w, lambda x, i: CASE WHEN i % 8 = 0 THEN '<' || x || ':OG>'
    WHEN i % 4 = 0 THEN '<' || x || ':PS>' WHEN i % 6 = 0 THEN '<' || x || ':LC>' ELSE x END), ' ') AS pred,
  array_to_string(list_transform(w, lambda x, i: CASE WHEN i % 4 = 0 THEN '<' || x || ':PS>' ELSE x END), ' ') AS gold FROM ({_WORDS_SQL})"""


def tagged_turns(spark, sf):
    """Every fourth word is an entity; the prediction mistakes some and adds others."""
    found = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)

    def tagged(kind):
        return F.array_join(F.transform(found, lambda w, i: F.when(
            kind(i + 1).isNotNull(), F.concat(F.lit("<"), w, F.lit(":"), kind(i + 1), F.lit(">"))).otherwise(w)), " ")

    gold = tagged(lambda i: F.when(i % 4 == 0, "PS"))
    pred = tagged(lambda i: F.when(i % 8 == 0, "OG").when(i % 4 == 0, "PS").when(i % 6 == 0, "LC"))
    return texts(spark, sf, "conversations").select("conv_id", "turn", pred.alias("pred"), gold.alias("gold"))


@QUERIES.add(f"""
WITH t AS (SELECT {_PRED_TAGS_SQL} AS p, {_GOLD_TAGS_SQL} AS g FROM ({_WORDS_SQL})),
c AS (SELECT len(list_filter(g, lambda x: list_filter(p, lambda y: y.w = x.w)[-1].t = x.t)) AS ok,
  greatest(len(p), 1) AS np, len(g) AS ng FROM t),
s AS (SELECT sum(ok)::BIGINT AS n_correct, sum(np)::BIGINT AS n_pred, sum(ng)::BIGINT AS n_gold FROM c)
SELECT *, round(n_correct / n_pred, 9) AS precision, round(n_correct / n_gold, 9) AS recall,
  round(2 * (n_correct / n_pred) * (n_correct / n_gold) / (n_correct / n_pred + n_correct / n_gold + 1e-8), 9) AS f1 FROM s""")
def e11_entity_f1(spark, sf):
    scored = tagging.entity_f1(tagged_turns(spark, sf))
    return scored.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


def _marks_sql(tags: str, kind: str) -> str:
    return f"""list_aggregate(list_concat([0], list_transform({tags}, lambda e: CASE WHEN e.t = '{{t}}' THEN {kind} ELSE 0 END)), 'sum')"""


@QUERIES.add(f"""
WITH t AS (SELECT {_PRED_TAGS_SQL} AS p, {_GOLD_TAGS_SQL} AS g FROM ({_WORDS_SQL})),
c AS (SELECT len(g) AS ng, {", ".join(
    f"{_marks_sql(side, kind).format(t=tag)} AS {side}{name}_{tag}"
    for side in ("p", "g") for name, kind in (("b", "1"), ("i", "length(e.w) - 1")) for tag in ("PS", "OG", "LC"))} FROM t),
r AS (SELECT CASE WHEN ng > 0 THEN {" + ".join(f"p{n}_{t}" for n in "bi" for t in ("PS", "OG", "LC"))} ELSE 0 END AS p,
  {" + ".join(f"g{n}_{t}" for n in "bi" for t in ("PS", "OG", "LC"))} AS g,
  {" + ".join(f"least(p{n}_{t}, g{n}_{t})" for n in "bi" for t in ("PS", "OG", "LC"))} AS m FROM c)
SELECT round(100 * 2 * (sum(m) / sum(p)) * (sum(m) / sum(g)) / (sum(m) / sum(p) + sum(m) / sum(g)), 7) AS chrf,
  count(*) AS n_rows FROM r""")
def e12_iob_word_f1(spark, sf):
    return tagging.iob_word_f1(tagged_turns(spark, sf)).withColumn("chrf", F.round("chrf", 7))


_RELATIONS = [(3, "NP_SBJ"), (2, "VP")]


def _dependency_predictions(spark, sf):
    """By item: the last two relations missing, two added, heads shifted, or some relations broken."""
    rows = F.arrays_zip("index", "head", "deprel")

    def text(head, label):
        return F.transform(rows, lambda r: F.concat(F.lit("("), r["index"].cast("string"), F.lit("/1, "),
                                                    head(r), F.lit(", "), label(r), F.lit(")")))

    right = text(lambda r: r["head"].cast("string"), lambda r: r["deprel"])
    shifted = text(lambda r: F.when(r["index"] % 3 == 0, r["head"] + 1).otherwise(r["head"]).cast("string"),
                   lambda r: F.when(r["index"] % 5 == 0, F.lit("VNP_CMP")).otherwise(r["deprel"]))
    broken = F.transform(right, lambda x, i: F.when(i % 4 == 0, F.lit("(?)")).otherwise(x))
    extra = F.concat(right, F.array(F.lit("(1/1, 1, NP)"), F.lit("(1/1, 1, NP)")))
    kind = F.col("row_id") % 4
    chosen = (F.when(kind == 0, F.slice(right, F.lit(1), F.size(right) - 2)).when(kind == 1, extra)
              .when(kind == 2, shifted).otherwise(broken))

    def line(parts):
        return F.concat(F.lit("deprel: "), F.array_join(parts, "▁"))

    return parsed_sentences(spark, sf).select("row_id", line(right).alias("gold"), line(chosen).alias("pred"))


_WORD_PAIRS_SQL = """
w AS (SELECT item_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i,
  len(string_split(text, ' ')) AS n FROM benchmark),
g AS (SELECT item_id, i, n, item_id % 4 AS k, i - 1 AS gold_head, CASE WHEN i % 3 = 0 THEN 3 ELSE 2 END AS gold_label FROM w),
h AS (SELECT *, CASE WHEN k = 0 AND i > n - 2 THEN -2 WHEN k = 2 AND i % 3 = 0 THEN gold_head + 1
    WHEN k = 3 AND i % 4 = 1 THEN -2 ELSE gold_head END AS head,
  CASE WHEN k = 0 AND i > n - 2 THEN -2 WHEN k = 2 AND i % 5 = 0 THEN -3 WHEN k = 3 AND i % 4 = 1 THEN -2
    ELSE gold_label END AS raw FROM g),
pairs AS (SELECT *, CASE WHEN head <> gold_head THEN -2 ELSE raw END AS label FROM h)"""


@QUERIES.add(f"WITH {_WORD_PAIRS_SQL} SELECT item_id AS row_id, i - 1 AS place, gold_head, head, gold_label, label FROM pairs", ints=("place", "gold_head", "head"))
def e14_dependency_align(spark, sf):
    """Parsed, padded or cut to the gold length, labels cleared where the head is wrong."""
    aligned = dependency.align_dependencies(_dependency_predictions(spark, sf))
    return aligned.select("row_id", F.posexplode("pairs").alias("place", "w")).select("row_id", "place", "w.*")


@QUERIES.add("""
SELECT count(*) FILTER (item_id % 4 = 0) AS n_shorter, count(*) FILTER (item_id % 4 = 1) AS n_longer,
  sum(CASE WHEN item_id % 4 = 3 THEN (len(string_split(text, ' ')) + 3) // 4 ELSE 0 END)::BIGINT AS n_failures,
  count(*) AS n_rows FROM benchmark""")
def e13_dependency_failures(spark, sf):
    return dependency.attachment_counts(dependency.align_dependencies(_dependency_predictions(spark, sf)))


def _f1_sql(name: str, pred: str, gold: str) -> str:
    return f"""
SELECT '{name}' AS score, round(100 * (SELECT avg(f) FROM (
    SELECT 2.0 * sum(tp) / sum(s + q) AS f FROM (
      SELECT {gold} AS c, ({gold} = {pred})::INT AS tp, 1 AS s, 0 AS q FROM pairs
      UNION ALL SELECT {pred}, 0, 0, 1 FROM pairs) GROUP BY c)), 7) AS macro_f1,
  round(100 * (SELECT avg(({gold} = {pred})::INT) FROM pairs), 7) AS micro_f1"""


@QUERIES.add(f"WITH {_WORD_PAIRS_SQL} {_f1_sql('UAS', 'head', 'gold_head')} UNION ALL {_f1_sql('LAS', 'label', 'gold_label')}")
def e15_attachment(spark, sf):
    scored = dependency.attachment_scores(dependency.align_dependencies(_dependency_predictions(spark, sf)))
    return scored.withColumns({c: F.round(c, 7) for c in ("macro_f1", "micro_f1")})


_SLOTS_SQL = """SELECT conv_id, turn, list_filter(w, lambda x, i: i % 2 = 0 AND turn <> 3) AS gold,
  list_filter(w, lambda x, i: i % 3 = 0 AND turn <> 2) AS pred
  FROM (SELECT *, string_split(lower(text), ' ') AS w FROM conversations)"""


@QUERIES.add(f"""
WITH c AS (SELECT gold, pred, len(list_filter(gold, lambda x: list_contains(pred, x))) AS tp,
  len(list_filter(pred, lambda x: NOT list_contains(gold, x))) AS fp FROM ({_SLOTS_SQL})),
s AS (SELECT CASE WHEN len(gold) = 0 THEN (len(pred) = 0)::INT WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p,
  CASE WHEN len(gold) = 0 THEN (len(pred) = 0)::INT ELSE tp / len(gold) END AS r FROM c)
SELECT round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 9) AS f1, round(avg(r), 9) AS recall,
  round(avg(p), 9) AS precision, count(*) AS n_rows FROM s""")
def e16_dialogue_slots(spark, sf):
    w = F.split(F.lower("text"), " ", -1)
    gold = F.filter(w, lambda x, i: ((i + 1) % 2 == 0) & (F.col("turn") != 3))
    pred = F.filter(w, lambda x, i: ((i + 1) % 3 == 0) & (F.col("turn") != 2))
    slots = texts(spark, sf, "conversations").select(gold.alias("gold"), pred.alias("pred"))
    scored = states.dialogue_state_score(slots)
    return scored.withColumns({c: F.round(c, 9) for c in ("f1", "recall", "precision")})


@QUERIES.add("""
WITH s AS (SELECT item_id, text, lower(text) AS low, item_id // 8 AS b, max(strlen(text) + 1) OVER (PARTITION BY item_id // 8) AS m
  FROM benchmark),
e AS (SELECT b, m, m - strlen(text) + len(list_filter(range(0, strlen(text)), lambda i:
  substr(hex(encode(text)), (2 * i + 1)::INT, 2) = substr(hex(encode(low)), (2 * i + 1)::INT, 2))) AS same FROM s)
SELECT round(avg(a), 9) AS token_accuracy, count(*) AS n_batches FROM (SELECT sum(same) / sum(m) AS a FROM e GROUP BY b)""")
def e17_token_accuracy(spark, sf):
    rows = texts(spark, sf, "benchmark").select("item_id", F.lower("text").alias("input_text"),
                                                F.col("text").alias("target_text"))
    batches = pad_batch(rows, 8, order="item_id", dense=True).withColumnRenamed("input_ids", "pred_ids")
    return states.token_accuracy(batches).withColumn("token_accuracy", F.round("token_accuracy", 9))


@QUERIES.add(f"SELECT count(*) FILTER (pred <> gold) AS n_differ, count(*) AS n_rows FROM ({_CHANGED_SQL})")
def e18_mismatch_count(spark, sf):
    return prediction.mismatch_count(changed_turns(spark, sf), "pred", "gold")


def _metrics_sql(parts: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS metric, round(({value})::DOUBLE, 7) AS value" for name, value in parts.items())


def _rouge_parts_sql(rows: str, key: str) -> dict[str, str]:
    """One-line predictions that leave words out: all their tokens are the longest common subsequence."""
    tokens = f"SELECT len({_ROUGE_WORDS_SQL.format('pred')}) AS p, len({_ROUGE_WORDS_SQL.format('gold')}) AS g FROM ({rows})"
    longest = f"SELECT avg(CASE WHEN p = 0 THEN 0 ELSE 2.0 * p / (p + g) END) FROM ({tokens})"
    return {"rouge1": f"SELECT avg(f) FROM ({_rouge_n_sql(1, rows, key)})",
            "rouge2": f"SELECT avg(f) FROM ({_rouge_n_sql(2, rows, key)})", "rougeL": longest, "rougeLsum": longest}


_LINE_ITEMS_SQL = _ITEMS_SQL.replace("FROM benchmark", "FROM (SELECT item_id, replace(text, chr(10), ' ') AS text FROM benchmark)")
_LINE_TURNS_SQL = _CHANGED_SQL.replace("FROM conversations", "FROM (SELECT * REPLACE (replace(text, chr(10), ' ') AS text) FROM conversations)")


def _reading_parts_sql() -> dict[str, str]:
    normal = f"SELECT {_reading_sql('pred')} AS p, {_reading_sql('gold')} AS g FROM ({_LINE_ITEMS_SQL})"
    run = f"SELECT *, {_RUN_SQL.format(p='p', g='g')} AS run FROM ({normal})"
    words = (f"SELECT {_SQUAD_TOKENS_SQL.format(_reading_sql('pred'))} AS p, "
             f"{_SQUAD_TOKENS_SQL.format(_reading_sql('gold'))} AS g FROM ({_LINE_ITEMS_SQL})")
    # The prediction's words are all in the gold answer.
    return {"exact_match": f"SELECT avg((p = g)::INT) FROM ({normal})",
            "rouge_w": f"SELECT avg(2.0 * run / (length(p) + length(g))) FROM ({run})",
            "squad_exact_match": f"SELECT 100 * avg((p = g)::INT) FROM ({words})",
            "squad_f1": f"SELECT 100 * avg(2.0 * len(p) / (len(p) + len(g))) FROM ({words})",
            **_rouge_parts_sql(_LINE_ITEMS_SQL, "item_id")}


@QUERIES.add(_metrics_sql(_reading_parts_sql()))
def evaluate_reading_task(spark, sf):
    """All metrics of the reading task in one pass over parsed predictions."""
    rows = _changed_items(spark, sf, one_line=True)
    told = rows.select(F.concat(F.lit("출력: "), "pred", F.lit("\n정답임")).alias("prediction"), F.array("gold").alias("golds"))
    return evaluate_task("klue-mrc", told, "prediction", "golds").withColumn("value", F.round("value", 7))


@QUERIES.add(_metrics_sql({
    "exact_match": f"SELECT avg((pred = gold)::INT) FROM ({_LINE_TURNS_SQL})",
    "chrf": f"SELECT chrf FROM ({_chrf_sql(_LINE_TURNS_SQL, 6, 2.0)})", **_rouge_parts_sql(_LINE_TURNS_SQL, "conv_id, turn")}))
def evaluate_text_task(spark, sf):
    """Exact match, chrF and ROUGE of free text in one pass."""
    scored = evaluate_task("klue-ner", changed_turns(spark, sf, one_line=True), "pred", "gold")
    return scored.withColumn("value", F.round("value", 7))
