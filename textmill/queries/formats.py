"""Text-to-text formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hashing import hash_bucket
from ..operators import formatting as fmt
from ..plans.tasks import format_task, prepare
from . import Registry, sql_hash, table, texts

QUERIES = Registry()


def _documents(spark, sf):
    return table(spark, sf, "documents").withColumnRenamed("doc_id", "row_id")


def _labelled(spark, sf):
    return _documents(spark, sf).join(table(spark, sf, "labels").withColumnRenamed("doc_id", "row_id"), "row_id")


def _turns(spark, sf):
    return table(spark, sf, "conversations").withColumn("row_id", F.col("conv_id") * 1000 + F.col("turn"))


@QUERIES.add("""
SELECT doc_id AS row_id, text AS input_text, CASE toxic WHEN 0 THEN 'positive' ELSE 'negative' END AS target_text
FROM documents JOIN labels USING (doc_id)""")
def f1_plain(spark, sf):
    return fmt.format_plain(_labelled(spark, sf), "text", "toxic", {0: "positive", 1: "negative"})


@QUERIES.add("""
SELECT doc_id AS row_id, 'nsmc sentiment classification: ' || text AS input_text,
  'answer => ' || CASE toxic WHEN 0 THEN 'positive' ELSE 'negative' END AS target_text
FROM documents JOIN labels USING (doc_id)""")
def f2_template(spark, sf):
    return fmt.format_template(_labelled(spark, sf), "text", "toxic", "nsmc sentiment classification: {{ input }}",
                               "answer => {{ label }}", {0: "positive", 1: "negative"})


@QUERIES.add(f"""
SELECT conv_id * 1000 + turn AS row_id, 'NLI, 전제: ' || role || E'\\n가설: ' || text || E'\\n' AS input_text,
  ['함의', '모순', '중립'][{sql_hash('conv_id * 1000 + turn', 1)} % 3 + 1] AS target_text FROM conversations""")
def f3_nli(spark, sf):
    rows = _turns(spark, sf).select("row_id", F.col("role").alias("premise"), F.col("text").alias("hypothesis"),
                                    hash_bucket(F.col("row_id"), 3, 1).cast("int").alias("label"))
    return fmt.format_nli(rows)


@QUERIES.add(f"""
SELECT conv_id * 1000 + turn AS row_id, 'KLUE YNAT task: ' || text || E'\\n' AS input_text,
  ['IT과학', '경제', '사회', '생활문화', '세계', '스포츠', '정치'][{sql_hash('conv_id * 1000 + turn', 2)} % 7 + 1]
    AS target_text FROM conversations""")
def f4_topic(spark, sf):
    rows = _turns(spark, sf).select("row_id", F.col("text").alias("title"),
                                    hash_bucket(F.col("row_id"), 7, 2).cast("int").alias("label"))
    return fmt.format_topic(rows)


_CORRUPT_SQL = f"""
CASE WHEN length(answer) = 0 THEN answer ELSE
  left(answer, ({sql_hash('row_id', '0:place')} % length(answer))::INT) ||
  CASE WHEN regexp_matches(answer[({sql_hash('row_id', '0:place')} % length(answer))::INT + 1], '^[0-9]$')
    THEN ((TRY_CAST(answer[({sql_hash('row_id', '0:place')} % length(answer))::INT + 1] AS INT) + 1
      + {sql_hash('row_id', '0:digit')} % 9) % 10)::VARCHAR
    ELSE chr((44032 + {sql_hash('row_id', '0:letter')} % 11183)::INT) END ||
  substr(answer, ({sql_hash('row_id', '0:place')} % length(answer))::INT + 2) END"""

_ANSWERS_SQL = f"""
SELECT conv_id * 1000 + turn AS row_id, role, text,
  string_split(text, ' ')[1] ||
    CASE WHEN turn % 3 = 0 THEN (conv_id * 7)::VARCHAR ELSE '' END AS answer,
  {sql_hash('conv_id * 1000 + turn', 5)} % 3 = 0 AS plausible FROM conversations"""


def _answers(spark, sf):
    first = F.split("text", " ", -1)[0]
    number = F.when(F.col("turn") % 3 == 0, (F.col("conv_id") * 7).cast("string")).otherwise("")
    return _turns(spark, sf).select(
        "row_id", F.col("role").alias("question"), F.col("text").alias("context"),
        F.struct(F.concat(first, number).alias("text"), F.lit(0).alias("start_idx")).alias("answers"),
        (hash_bucket(F.col("row_id"), 3, 5) == 0).alias("plausible_answer"))


@QUERIES.add(f"""
WITH rows AS ({_ANSWERS_SQL}),
drawn AS (SELECT *, {sql_hash('row_id', '0:choice')} % 100 AS choice, {sql_hash('row_id', '0:digit-draw')} % 10 AS dd,
  {_CORRUPT_SQL} AS corrupted FROM rows)
SELECT row_id, 'task: MRC, 지문을 읽고 질문에 답을 할 수 없다면 ''[알 수 없음]''을 출력한다.' || E'\\n\\n### 질문\\n' || role
    || E'\\n\\n### 지문\\n' || text || E'\\n' AS input_text,
  '출력: ' || CASE
    WHEN plausible AND choice > 20 THEN '[알 수 없음]' || E'\\n정답임'
    WHEN plausible THEN answer || E'\\n정답이 아님, 새 정답: [알 수 없음]'
    WHEN choice < 3 OR (regexp_matches(answer, '[0-9]') AND dd < 1)
      THEN corrupted || E'\\n정답이 아님, 새 정답: ' || answer
    WHEN choice < 23 THEN '[알 수 없음]' || E'\\n정답이 아님, 새 정답: ' || answer
    ELSE answer || E'\\n정답임' END AS target_text FROM drawn""")
def f5_mrc(spark, sf):
    return fmt.format_mrc(_answers(spark, sf))


@QUERIES.add(f"WITH rows AS ({_ANSWERS_SQL}) SELECT row_id, answer, {_CORRUPT_SQL} AS corrupted FROM rows")
def f6_corrupt_answer(spark, sf):
    answer = F.col("answers.text")
    return _answers(spark, sf).select("row_id", answer.alias("answer"),
                                      fmt.corrupt_answer(answer, F.col("row_id"), 0).alias("corrupted"))


@QUERIES.add(r"""
WITH pieces AS (
  SELECT doc_id, string_split(regexp_replace(text, '(.+?[a-z]{3}[.?!]+)( +|$)', chr(1) || '\1' || chr(1) || '\2'
    || chr(1), 'g'), chr(1)) AS p FROM documents),
kept AS (SELECT doc_id, unnest(list_filter(p, lambda x: length(x) > 1)) AS piece,
  generate_subscripts(list_filter(p, lambda x: length(x) > 1), 1) - 1 AS i FROM pieces)
SELECT doc_id, i::INT AS i, i || ' // ' || regexp_replace(piece, '^\s+|\s+$', '', 'g') AS sentence FROM kept""")
def f7_sentences(spark, sf):
    """With Latin letters, since the given documents hold no Hangul."""
    return texts(spark, sf, "documents").select(
        "doc_id", F.posexplode(tx.numbered_sentences(F.col("text"), "a-z")).alias("i", "sentence"))


_TAGGED_SQL = """
SELECT item_id AS row_id, regexp_replace(regexp_replace(text, '([A-Z][a-z]+)', '<\\1:PS>', 'g'), '(on) ',
  '<\\1:OG>;;; ', 'g') AS tagged FROM benchmark""".replace("\\\\", "\\")


def _tagged(spark, sf):
    names = F.regexp_replace("text", "([A-Z][a-z]+)", "<$1:PS>")
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("row_id"), F.regexp_replace(names, "(on) ", "<$1:OG>;;; ").alias("tagged_sent"))


@QUERIES.add(rf"""
WITH t AS (SELECT row_id, regexp_replace(tagged, ';+', ';', 'g') AS s FROM ({_TAGGED_SQL}))
SELECT row_id, E'task: NER\n\n### 입력\n' || regexp_replace(s, '<(.+?):[A-Z][A-Z]>', '\1', 'g') || E'\n' AS input_text,
  s AS target_text FROM t""")
def f8_ner(spark, sf):
    return fmt.format_ner(_tagged(spark, sf))


@QUERIES.add(rf"""
WITH t AS (SELECT row_id, regexp_replace(tagged, ';+', ';', 'g') AS s FROM ({_TAGGED_SQL}))
SELECT row_id, E'task: NER\n\n### 입력\n' || regexp_replace(s, '<(.+?):[A-Z][A-Z]>', '\1', 'g') || E'\n' AS input_text,
  array_to_string(regexp_extract_all(s, '<.+?:[A-Z][A-Z]>'), ' ') AS target_text FROM t""")
def f8_ner_tags_only(spark, sf):
    return fmt.format_ner(_tagged(spark, sf), only_tags=True)


_PARSED_SQL = """
SELECT item_id AS row_id, text AS sentence, list_transform(string_split(text, ' '), lambda w, i: {
  'i': i::BIGINT, 'w': w, 'n': length(w), 'l': lower(w) || ' x' || i, 'p': CASE WHEN i % 2 = 0 THEN 'NNG+JKS' ELSE 'VV' END,
  'h': i::BIGINT - 1, 'd': CASE WHEN i % 3 = 0 THEN 'NP_SBJ' ELSE 'VP' END}) AS ws FROM benchmark"""
_MA_OUT_SQL = """array_to_string(list_transform(ws, lambda r: r.i || '/' || r.w || '/' || r.n || '/' || r.l || '/' || r.p
  || '/' || string_split(r.l, ' ')[1] || ':' || string_split(r.p, '+')[1] || '/' ||
  CASE WHEN len(string_split(r.p, '+')) = 1 THEN 'NONE'
    ELSE string_split(r.l, ' ')[-1] || ':' || string_split(r.p, '+')[-1] END || E'\\n'), '')"""
_DEP_LABEL_SQL = """'deprel: ' || array_to_string(list_transform(ws,
  lambda r: '(' || r.i || '/' || r.n || ', ' || r.h || ', ' || r.d || ')'), '▁') || E'\\nword_counts: ' || len(ws)"""


def parsed_sentences(spark, sf, one_line: bool = False):
    """Sentences whose words carry made-up lemmas, tags, heads and relations."""
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(" ")) if one_line else F.col("text")
    words = F.split(text, " ", -1)

    def column(build):
        return F.transform(words, build)

    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("row_id"), text.alias("sentence"),
        column(lambda w, i: i + 1).alias("index"), words.alias("word_form"),
        column(lambda w, i: F.concat(F.lower(w), F.lit(" x"), (i + 1).cast("string"))).alias("lemma"),
        column(lambda w, i: F.when((i + 1) % 2 == 0, "NNG+JKS").otherwise("VV")).alias("pos"),
        column(lambda w, i: i).alias("head"),
        column(lambda w, i: F.when((i + 1) % 3 == 0, "NP_SBJ").otherwise("VP")).alias("deprel"))


@QUERIES.add(f"""
SELECT row_id, E'task: Dependency Parsing\\n\\nInput: ' || sentence || E'\\nLemmas: ' || {_MA_OUT_SQL} AS input_text,
  {_DEP_LABEL_SQL} AS target_text FROM ({_PARSED_SQL})""")
def f9_dependency(spark, sf):
    return fmt.format_dependency(fmt.build_dependency_strings(parsed_sentences(spark, sf)))


@QUERIES.add(f"SELECT row_id, {_MA_OUT_SQL} AS ma_out, {_DEP_LABEL_SQL} AS label FROM ({_PARSED_SQL})")
def f10_dependency_strings(spark, sf):
    return fmt.build_dependency_strings(parsed_sentences(spark, sf)).select("row_id", "ma_out", "label")


@QUERIES.add("""
SELECT conv_id * 1000 + turn AS row_id, E'task: MRC\\n\\nquestion: ' || role || E'\\n\\ncontext: ' || text || E'\\n'
  AS input_text, string_split(text, ' ')[2] AS target_text FROM conversations""")
def f11_qa(spark, sf):
    rows = _turns(spark, sf).select("row_id", F.col("role").alias("question"), F.col("text").alias("context"),
                                    F.get(F.split("text", " ", -1), F.lit(1)).alias("label"))
    return fmt.format_qa(rows)


@QUERIES.add(f"""
SELECT conv_id * 1000 + turn AS row_id, E'paraphrase detection task:\\n\\nsentence-1: ' || role || E'\\nsentence-2: '
  || text || E'\\n' AS input_text, ['different', 'paraphrase'][{sql_hash('conv_id * 1000 + turn', 3)} % 2 + 1]
  AS target_text FROM conversations""")
def f12_paraphrase(spark, sf):
    rows = _turns(spark, sf).select("row_id", F.col("role").alias("sentence1"), F.col("text").alias("sentence2"),
                                    hash_bucket(F.col("row_id"), 2, 3).cast("int").alias("label"))
    return fmt.format_paraphrase(rows)


@QUERIES.add("""
SELECT doc_id AS row_id, '#TITLE ' || source || E'\\n#CONTENT ' || text AS input_text, 'language ' || lang AS target_text
FROM documents""")
def f13_title_content(spark, sf):
    """The label map is a Column function."""
    return fmt.format_title_content(_documents(spark, sf), "source", "text", "lang",
                                    lambda label: F.concat(F.lit("language "), label))


@QUERIES.add("""
SELECT doc_id AS row_id, 'nsmc sentiment classification: ' || text AS input_text,
  CASE toxic WHEN 0 THEN 'positive' ELSE 'negative' END AS target_text FROM documents JOIN labels USING (doc_id)""")
def f14_task(spark, sf):
    rows = _labelled(spark, sf).withColumnsRenamed({"text": "document", "toxic": "label"})
    return format_task("nsmc-prompted", rows.select("row_id", "document", "label"))


@QUERIES.add(f"""
WITH rows AS (
  SELECT doc_id, text, lang, CASE WHEN {sql_hash('doc_id', 59282)} / 4294967296.0 < 0.1 THEN 'test'
    WHEN {sql_hash('doc_id', 39581)} / 4294967296.0 < 0.1 THEN 'validation' ELSE 'train' END AS split FROM documents),
kept AS (SELECT * FROM rows WHERE split = 'test' OR strlen(text) + 1 + strlen(lang) + 1 < 4096)
SELECT split, lang, count(*) AS n_rows, sum(least(strlen(text) + 1, 4096))::BIGINT AS n_input_ids,
  sum(strlen(lang) + 1)::BIGINT AS n_label_ids FROM kept GROUP BY ALL""")
def f14_prepare(spark, sf):
    """Rows to encoded training examples: split, format, filter, encode; counted per split and language."""
    rows = texts(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("label"))
    ready = prepare("jsonlines", rows, valid_proportion=0.1, test_proportion=0.1, max_len=4096)
    from ..functions.byte_ids import byte_decode

    return ready.groupBy("split", byte_decode(F.col("labels")).alias("lang")).agg(
        F.count("*").alias("n_rows"), F.sum(F.size("input_ids")).alias("n_input_ids"),
        F.sum(F.size("labels")).alias("n_label_ids"))


def _named(task: str, build, sql: str, label_map=None) -> None:
    """A query that formats the rows of `build` by the named task."""
    def run(spark, sf):
        return format_task(task, build(spark, sf), label_map)

    run.__name__ = "f14_" + task.replace("-", "_").replace(" ", "_")
    QUERIES.add(sql)(run)


def _nli_rows(spark, sf):
    return _turns(spark, sf).select("row_id", F.col("role").alias("premise"), F.col("text").alias("hypothesis"),
                                    hash_bucket(F.col("row_id"), 3, 1).cast("int").alias("label"))


def _renamed(**names):
    return lambda spark, sf: _labelled(spark, sf).select("row_id", *(F.col(old).alias(new) for new, old in names.items()))


def _titles(spark, sf):
    """Titles with one of two classes, by the row's hash."""
    return _turns(spark, sf).select("row_id", F.col("role").alias("title"), F.col("text").alias("content"),
                                    hash_bucket(F.col("row_id"), 2, 3).cast("int").alias("label"))


_PLAIN_SQL = """
SELECT doc_id AS row_id, text AS input_text, {} AS target_text FROM documents JOIN labels USING (doc_id)"""
_CLASS_SQL = f"['first', 'second'][{sql_hash('conv_id * 1000 + turn', 3)} % 2 + 1]"
_named("nsmc-naive", _renamed(document="text", label="toxic"),
       _PLAIN_SQL.format("CASE toxic WHEN 0 THEN 'positive' ELSE 'negative' END"))
_named("klue-nli", _nli_rows, QUERIES["f3_nli"].sql)
# Here the classes are entailment, neutral and contradiction, in this order.
_named("kornli-prompted", _nli_rows, QUERIES["f3_nli"].sql.replace("['함의', '모순', '중립']", "['함의', '중립', '모순']"))
_named("klue-ynat", lambda spark, sf: _turns(spark, sf).select(
    "row_id", F.col("text").alias("title"), hash_bucket(F.col("row_id"), 7, 2).cast("int").alias("label")), QUERIES["f4_topic"].sql)
_named("paws-x-kor", lambda spark, sf: _titles(spark, sf).withColumnsRenamed({"title": "sentence1", "content": "sentence2"}),
       QUERIES["f12_paraphrase"].sql)
_named("kr-internal", _titles, f"""
SELECT conv_id * 1000 + turn AS row_id, '#TITLE ' || role || E'\\n#CONTENT ' || text AS input_text, {_CLASS_SQL} AS target_text
FROM conversations""", {0: "first", 1: "second"})
_named("kr-internal-mtl", _titles, f"""
SELECT conv_id * 1000 + turn AS row_id, E'Multitask classification:\\n\\n' || role AS input_text, {_CLASS_SQL} AS target_text
FROM conversations""", {0: "first", 1: "second"})
_named("klue-mrc", lambda spark, sf: _answers(spark, sf).withColumn(
    "answers", F.array(F.struct(F.lit("an earlier answer").alias("text"), F.lit(3).alias("start_idx")), "answers")), QUERIES["f5_mrc"].sql)
_named("klue-ner", _tagged, QUERIES["f8_ner"].sql)
_named("klue-dp", parsed_sentences, QUERIES["f9_dependency"].sql)
_named("korquad-v1", lambda spark, sf: _turns(spark, sf).select(
    "row_id", F.col("role").alias("question"), F.col("text").alias("context"),
    F.get(F.split("text", " ", -1), F.lit(1)).alias("label")), QUERIES["f11_qa"].sql)
_named("hfdataset", _renamed(text="text", label="lang"), _PLAIN_SQL.format("lang"))
_named("jsonlines", _renamed(text="text", label="source"), _PLAIN_SQL.format("source"))
_named("any other name", _renamed(text="text", target_text="lang"), _PLAIN_SQL.format("lang"))
