"""Sources and sinks: the given tables are written as files by Spark and read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.hashing import hash_bucket
from ..operators.dataset import train_test_split
from ..operators.tokens import pad_batch
from ..session import scratch_path
from ..sources import answers, benchmarks, lines, pairs, questions
from . import Registry, sql_hash, table, texts
from .data import _SPLIT_SQL
from .formats import _PARSED_SQL, parsed_sentences
from ..plans.files import generate_lines, score_dependency_files, score_label_files, score_tag_files
from ..plans.tasks import prepare
from .predictions import _STUB_SQL, load_stub
from .scores import (_FLIP_SQL, _SPACES_SQL, _TAGGED_SQL, _WORD_PAIRS_SQL, _chrf_sql, _dependency_predictions, _f1_sql, _report_sql,
                     flipped_events, tagged_turns)
from .scores import QUERIES as SCORES

QUERIES = Registry()


def _one_line(column):
    return F.translate(F.replace(column, F.lit("\n"), F.lit("\\n")), "\t\r", "  ")


_PAIR_LINES_SQL = r"""SELECT doc_id, replace(translate(text, chr(9) || chr(13), '  '), chr(10), '\n') AS t, lang, source,
  doc_id % 5 AS k FROM documents"""


def _write_pair_lines(spark, sf) -> str:
    """Good pairs, lines with one and three fields, and pairs with an empty last field."""
    text, k = _one_line(F.col("text")), F.col("doc_id") % 5
    line = (F.when(k == 0, text).when(k == 1, F.concat_ws("\t", text, "lang", "source"))
            .when(k == 2, F.concat(text, F.lit("\t")))
            .otherwise(F.concat(F.lit("  "), F.concat_ws("\t", F.col("lang"), text), F.lit(" \t"))))
    path = scratch_path(spark, "pairs.tsv")
    texts(spark, sf, "documents").select(line).write.text(path)
    return path


def _strip_sql(text: str) -> str:
    space = _SPACES_SQL.strip("'")
    return f"regexp_replace({text}, '^{space}|{space}$', '', 'g')"


@QUERIES.add(f"""
SELECT lang AS text, replace({_strip_sql('t')}, '\\n', chr(10)) AS target_text FROM ({_PAIR_LINES_SQL}) WHERE k >= 3""")
def s1_tsv_pairs(spark, sf):
    return pairs.read_tsv_pairs(spark, _write_pair_lines(spark, sf))


@QUERIES.add(f"""
SELECT CASE k WHEN 1 THEN 3 ELSE 1 END AS field_count, count(*) AS n FROM ({_PAIR_LINES_SQL}) WHERE k < 3 GROUP BY ALL""")
def s1_tsv_rejects(spark, sf):
    rejected = pairs.rejected_pairs(spark.read.text(_write_pair_lines(spark, sf)))
    return rejected.groupBy("field_count").agg(F.count("*").alias("n"))


@QUERIES.add("SELECT text, lang AS label FROM documents WHERE doc_id % 3 = 0")
def s2_jsonl_pairs(spark, sf):
    """Rows with a blank or missing label are dropped."""
    k = F.col("doc_id") % 3
    label = F.when(k == 0, F.col("lang")).when(k == 1, F.lit(" 　"))
    path = scratch_path(spark, "pairs.jsonl")
    texts(spark, sf, "documents").select("text", label.alias("label")).write.json(path)
    return pairs.read_jsonl_pairs(spark, path)


@QUERIES.add("SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM documents")
def s3_read_any(spark, sf):
    """A saved folder and a catalog name go through the same call; repeated inputs are concatenated."""
    path, name = scratch_path(spark, "saved"), "textmill_documents"
    docs = texts(spark, sf, "documents").select("doc_id", "text")
    docs.write.parquet(path)
    docs.createOrReplaceTempView(name)
    return pairs.concat_sources([pairs.read_any(spark, path), pairs.read_any(spark, name)])


@QUERIES.add(f"""
SELECT conv_id * 1000 + turn AS key, role AS premise, text AS hypothesis, {sql_hash('conv_id * 1000 + turn', 1)} % 3 AS label
FROM conversations""")
def s4_benchmark_json(spark, sf):
    key = F.col("conv_id") * 1000 + F.col("turn")
    names = F.array(*[F.lit(n) for n in ("entailment", "contradiction", "neutral")])
    path = scratch_path(spark, "nli.json")
    texts(spark, sf, "conversations").select(
        F.concat_ws("#", key.cast("string"), "role").alias("premise"), F.col("text").alias("hypothesis"),
        F.get(names, hash_bucket(key, 3, 1).cast("int")).alias("gold_label")).write.json(path)
    rows = benchmarks.read_benchmark_json(spark, "nli", path, json_lines=True)
    part = F.split("premise", "#")
    return rows.select(part[0].cast("long").alias("key"), part[1].alias("premise"), "hypothesis",
                       F.col("label").cast("long").alias("label"))


def _nested_documents(spark, sf):
    """Each document is one record with two paragraphs, and questions with answers, plausible ones or none."""
    start = F.length("text") - F.pmod(F.col("doc_id") * 7919, F.length("text")) - 1

    def answer(at):
        return F.array(F.struct(F.substr(F.col("text"), at + 1, F.lit(9)).alias("text"), at.cast("int").alias("answer_start")))

    none = F.array().cast("array<struct<text:string,answer_start:int>>")
    some = F.concat(answer(start), answer(F.lit(0)))

    def question(number, answers, plausible):
        return F.struct(F.concat_ws("-", F.col("doc_id").cast("string"), F.lit(number)).alias("id"),
                        F.col("source").alias("question"), answers.alias("answers"),
                        plausible.alias("plausible_answers"))

    paragraph = F.struct(F.col("text").alias("context"), F.array(
        question("0", some, none), question("1", none, answer(start)),
        question("2", none, F.lit(None).cast("array<struct<text:string,answer_start:int>>"))).alias("qas"))
    data = F.array(F.struct(F.col("lang").alias("title"), F.array(paragraph).alias("paragraphs")))
    return texts(spark, sf, "documents").select(data.alias("data"))


_START_SQL = "(length(text) - (doc_id * 7919) % length(text) - 1)"


@QUERIES.add(f"""
SELECT doc_id || '-0' AS qid, lang AS title, false AS plausible_answer, 2 AS n_answers,
  substr(text, {_START_SQL} + 1, 9) || '|' || substr(text, 1, 9) AS texts, {_START_SQL} || ' 0' AS starts, text AS context, source AS question
FROM documents
UNION ALL SELECT doc_id || '-1', lang, true, 1, substr(text, {_START_SQL} + 1, 9), ({_START_SQL})::VARCHAR, text, source FROM documents
UNION ALL SELECT doc_id || '-2', lang, false, 0, '', '', text, source FROM documents""")
def s5_reading_questions(spark, sf):
    path = scratch_path(spark, "mrc.json")
    _nested_documents(spark, sf).write.json(path)
    rows = benchmarks.read_reading_questions(spark, path, json_lines=True)
    return rows.select("qid", "title", "plausible_answer", F.size("answers").alias("n_answers"), F.array_join("answers.text", "|").alias("texts"),
                       F.array_join(F.col("answers.start_idx").cast("array<string>"), " ").alias("starts"), "context", "question")


@QUERIES.add("""
WITH t AS (SELECT item_id, w, unnest(range(len(w))) AS i FROM (
  SELECT item_id, string_split(text, ' ') AS w FROM benchmark))
SELECT item_id, i::INT AS turn_no, array_to_string(list_transform(w[1:i], lambda x, k: CASE WHEN k % 3 = 1 THEN 'user:' ELSE 'sys:' END || x), ' ') AS history,
  w[i + 1] AS sys_text,
  CASE WHEN i % 3 = 1 THEN w[i] ELSE w[i - 1] END AS label_state,
  CASE WHEN i % 3 = 2 THEN w[i - 1] WHEN i >= 4 THEN w[i - 3] ELSE '' END AS prev_state
FROM t WHERE i % 3 > 0""")
def s6_dialogue_records(spark, sf):
    """Nested records whose turns go user, system, system; the state of a user turn is its text."""
    turn = F.transform(F.split("text", " ", -1), lambda w, i: F.struct(
        F.when(i % 3 == 0, "user").otherwise("sys").alias("role"), w.alias("text"),
        F.when(i % 3 == 0, F.array(w)).alias("state")))
    path = scratch_path(spark, "dialogues.json")
    table(spark, sf, "benchmark").select(F.array(F.col("item_id").cast("string")).alias("domains"),
                                         turn.alias("dialogue")).write.json(path)
    rows = benchmarks.read_dialogue_states(spark, path, json_lines=True)
    return rows.select(F.col("domain")[0].cast("long").alias("item_id"), F.col("turn_no"),
                       F.array_join(F.transform("dialogue", lambda t: F.concat_ws(":", t["role"], t["text"])), " ").alias("history"), "sys_text",
                       F.array_join("label_state", " ").alias("label_state"),
                       F.array_join("prev_state", " ").alias("prev_state"))


@QUERIES.add(f"""
WITH t AS (SELECT conv_id * 1000 + turn AS key, translate(text, chr(9) || chr(10) || chr(13), '   ') AS x FROM conversations),
c AS (SELECT key, x, string_split(x, '') AS cs FROM t)
SELECT key, {_strip_sql("x")} AS tagged, array_to_string(list_transform(cs, lambda c: regexp_replace(c, {_SPACES_SQL}, '')), '') AS characters,
  array_to_string(list_transform(cs, lambda c: CASE WHEN regexp_matches(c, '[A-Z]') THEN '1' ELSE '0' END), '') AS labels FROM c""")
def s7_ner_blocks(spark, sf):
    text = F.translate("text", "\t\n\r", "   ")
    key = (F.col("conv_id") * 1000 + F.col("turn")).cast("string")
    body = F.transform(F.split(text, ""), lambda c: F.concat_ws("\t", c, F.when(c.rlike("[A-Z]"), "B-PS").otherwise("O")))
    block = F.concat(F.lit("## klue-ner-"), key, F.lit("\t"), key, F.lit("|"), text, F.lit("\n"), F.array_join(body, "\n"))
    path = scratch_path(spark, "ner.tsv")
    texts(spark, sf, "conversations").select(block).write.option("lineSep", "\n\n").text(path)
    rows = benchmarks.read_ner_blocks(spark, path)
    parts = F.split("tagged_sent", "[|]", 2)
    return rows.select(parts[0].cast("long").alias("key"), F.ltrim(parts[1]).alias("tagged"),
                       F.array_join("sentence", "").alias("characters"),
                       F.array_join(F.transform("labels", lambda x: x.cast("string")), "").alias("labels"))


_LINES_PARSED_SQL = _PARSED_SQL.replace("FROM benchmark", "FROM (SELECT item_id, replace(text, chr(10), ' ') AS text FROM benchmark)")


def _write_parse_blocks(spark, sf) -> str:
    rows = parsed_sentences(spark, sf, one_line=True)
    lines_ = F.transform(F.arrays_zip("index", "word_form", "lemma", "pos", "head", "deprel"), lambda r: F.concat_ws(
        "\t", r["index"].cast("string"), r["word_form"], r["lemma"], r["pos"], r["head"].cast("string"), r["deprel"]))
    head = F.concat(F.lit("## dp-"), F.col("row_id").cast("string"), F.lit("\t"), F.col("sentence"), F.lit("\n"))
    path = scratch_path(spark, "dp.tsv")
    rows.select(F.concat(head, F.array_join(lines_, "\n"))).write.option("lineSep", "\n\n").text(path)
    return path


@QUERIES.add(f"""
SELECT sentence, len(ws) AS n_words, array_to_string(list_transform(ws, lambda r: r.w), '/') AS words,
  array_to_string(list_transform(ws, lambda r: r.l), '/') AS lemma, array_to_string(list_transform(ws, lambda r: r.p), '/') AS pos,
  array_to_string(list_transform(ws, lambda r: r.h), ' ') AS head,
  array_to_string(list_transform(ws, lambda r: r.d), ' ') AS deprel FROM ({_LINES_PARSED_SQL})""", ints=("n_words",))
def s8_dependency_sentences(spark, sf):
    rows = benchmarks.read_dependency_sentences(spark, _write_parse_blocks(spark, sf))
    return rows.select(
        "sentence", F.size("index").alias("n_words"), F.array_join("word_form", "/").alias("words"),
        F.array_join("lemma", "/").alias("lemma"), F.array_join("pos", "/").alias("pos"),
        F.array_join(F.transform("head", lambda x: x.cast("string")), " ").alias("head"),
        F.array_join("deprel", " ").alias("deprel"))


@QUERIES.add(f"""
SELECT len(ws) AS n_words, array_to_string(list_transform(ws, lambda r: r.i), ' ') AS ids,
  array_to_string(list_transform(ws, lambda r: r.w), '/') AS words FROM ({_LINES_PARSED_SQL})""", ints=("n_words",))
def s8_dependency_blocks(spark, sf):
    rows = benchmarks.read_dependency_blocks(spark, _write_parse_blocks(spark, sf))
    return rows.select(F.size("ids").alias("n_words"),
                       F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"),
                       F.array_join("words", "/").alias("words"))


def _write_table(df, spark, name: str) -> str:
    path = scratch_path(spark, name)
    df.write.csv(path, sep="\t", header=True, quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
                 nullValue="", emptyValue="")
    return path


_CELL_SQL = "translate(text, chr(9) || chr(10) || chr(13), '   ')"


@QUERIES.add(f"""
SELECT conv_id || '-' || turn AS premise, {_CELL_SQL} AS hypothesis, [0, 2, 1][1 + {sql_hash('conv_id * 1000 + turn', 1)} % 3]::BIGINT AS label
FROM conversations WHERE turn <> 1""")
def s9_nli_table(spark, sf):
    """Rows with a missing cell are dropped; entailment is 0, neutral 1 and contradiction 2."""
    key = F.col("conv_id") * 1000 + F.col("turn")
    names = F.array(*[F.lit(n) for n in ("entailment", "contradiction", "neutral")])
    rows = texts(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sentence1"),
        F.when(F.col("turn") != 1, F.translate("text", "\t\n\r", "   ")).alias("sentence2"),
        F.get(names, hash_bucket(key, 3, 1).cast("int")).alias("gold_label"))
    read = benchmarks.read_nli_table(spark, _write_table(rows, spark, "nli.tsv"))
    return read.withColumn("label", F.col("label").cast("long"))


@QUERIES.add(f"""
SELECT conv_id % 4 AS genre, turn % 9 AS filename, conv_id % 7 AS year, (conv_id * 1000 + turn)::INT AS id, (turn % 11) / 2.0 AS score,
  {_CELL_SQL} AS sentence1, {_CELL_SQL} AS sentence2 FROM conversations""", ints=("genre", "filename", "year"))
def s9_sts_table(spark, sf):
    """Genre, file name and year come back as class ids."""
    def named(names, key):
        return F.get(F.array(*[F.lit(n) for n in names]), (F.col(key) % len(names)).cast("int"))

    cell = F.translate("text", "\t\n\r", "   ")
    rows = texts(spark, sf, "conversations").select(
        named(fv.STS_GENRES, "conv_id").alias("genre"), named(fv.STS_FILES, "turn").alias("filename"),
        named(fv.STS_YEARS, "conv_id").alias("year"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("turn") % 11 / 2).alias("score"),
        cell.alias("sentence1"), cell.alias("sentence2"))
    read = benchmarks.read_sts_table(spark, _write_table(rows, spark, "sts.tsv"))
    return read.withColumn("score", F.col("score").cast("double"))


@QUERIES.add(rf"""
WITH q AS (SELECT doc_id, text, source, {_START_SQL} AS start FROM documents),
l AS (SELECT *, string_split(regexp_replace(text, '([.?!]) ', '\1' || chr(1), 'g'), chr(1)) AS s FROM q)
SELECT doc_id || '-0' AS id, source AS text2, text AS text1, substr(text, start + 1, 9) || '|' || substr(text, 1, 9) AS labels,
  start || ' 0' AS places, CASE WHEN regexp_matches(substr(text, start, 2), '^[.?!] $') THEN ''
    ELSE s[len(regexp_extract_all(left(text, start), '[.?!] ')) + 1] END || '|' || s[1] AS sentences FROM l
UNION ALL SELECT doc_id || '-' || k, source, text, '', '', '' FROM q, (SELECT unnest([1, 2]) AS k)""")
def s10_flatten_questions(spark, sf):
    """Every question, with all its answers, their places and sentences."""
    flat = questions.flatten_questions(_nested_documents(spark, sf))
    return flat.select("id", "text2", "text1", F.array_join("label", "|").alias("labels"),
                       F.array_join(F.col("position.pos").cast("array<string>"), " ").alias("places"),
                       F.array_join("position.sent", "|").alias("sentences"))


@QUERIES.add(f"""
SELECT doc_id || '-0' AS id, text AS context, source AS question, substr(text, {_START_SQL} + 1, 9) AS label FROM documents
UNION ALL SELECT doc_id || '-' || k, text, source, NULL FROM documents, (SELECT unnest([1, 2]) AS k)""")
def s11_flat_questions(spark, sf):
    path = scratch_path(spark, "questions.jsonl")
    questions.flatten_questions(_nested_documents(spark, sf)).write.json(path)
    return questions.read_flat_questions(spark, path)


@QUERIES.add("SELECT doc_id, text AS text1 FROM documents")
def s12_compressed_records(spark, sf):
    path = scratch_path(spark, "docs.jsonl")
    texts(spark, sf, "documents").select("doc_id", F.col("text").alias("text1")).write.option("compression", "gzip").json(path)
    return pairs.read_json_records(spark, path, "doc_id long, text1 string")


@QUERIES.add(f"SELECT doc_id, lang FROM documents WHERE {_SPLIT_SQL} = 'validation'")
def s13_splits(spark, sf):
    path = scratch_path(spark, "splits")
    pairs.write_splits(train_test_split(texts(spark, sf, "documents"), 0.1, 0.2, key="doc_id"), path)
    return pairs.read_split(spark, path, "validation").select("doc_id", "lang")


@QUERIES.add("""
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, lang || chr(9) || source AS value FROM documents""")
def s14_lines(spark, sf):
    """Lines written in key order, and numbered over all part files when they are read."""
    path = scratch_path(spark, "lines.txt")
    rows = texts(spark, sf, "documents").select("doc_id", F.array("lang", "source").alias("items"))
    lines.write_lines(rows, path, "items", "doc_id")
    return lines.read_lines_indexed(spark, path).select("row_id", "value")


@QUERIES.add("SELECT doc_id::VARCHAR AS id, text AS prediction_text FROM documents")
def s15_answer_map(spark, sf):
    path = scratch_path(spark, "answers.json")
    lines.write_answer_map(texts(spark, sf, "documents"), path, "doc_id", "text")
    return lines.read_answer_map(spark, path)


@QUERIES.add("SELECT doc_id::VARCHAR AS id, text AS prediction_text FROM documents")
def s15_answer_object(spark, sf):
    """The answer map as one JSON object over many files."""
    path = scratch_path(spark, "answers")
    answers.write_answer_object(texts(spark, sf, "documents"), path, "doc_id", "text")
    return answers.read_answer_object(spark, path)


@QUERIES.add("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def s17_named_table(spark, sf):
    table(spark, sf, "documents").createOrReplaceTempView("textmill_named")
    return pairs.read_table(spark, "textmill_named").groupBy("lang").agg(F.count("*").alias("n"))


@QUERIES.add("""
SELECT doc_id AS id, lang AS text FROM documents UNION ALL SELECT item_id, text FROM benchmark
UNION ALL SELECT conv_id, text FROM conversations""")
def s18_concat_sources(spark, sf):
    names = (("documents", "doc_id", "lang"), ("benchmark", "item_id", "text"), ("conversations", "conv_id", "text"))
    return pairs.concat_sources([
        table(spark, sf, name).select(F.col(key).alias("id"), F.col(text).alias("text")) for name, key, text in names])


def _write_sides(spark, df, order: str) -> tuple[str, str]:
    paths = scratch_path(spark, "pred.txt"), scratch_path(spark, "gold.txt")
    for path, column in zip(paths, ("pred", "gold")):
        lines.write_lines(df, path, column, order)
    return paths


@QUERIES.add(f"""
SELECT r.*, first_row FROM ({_report_sql('pred')}) r LEFT JOIN (
  SELECT gold, min(n) AS first_row FROM (SELECT gold, row_number() OVER (ORDER BY event_id) - 1 AS n FROM ({_FLIP_SQL}))
  GROUP BY gold) f ON r.label = f.gold""")
def e3_report_files(spark, sf):
    """Predicted and gold labels written as lines, paired by line number and scored."""
    return score_label_files(spark, *_write_sides(spark, flipped_events(spark, sf), "event_id"))


@QUERIES.add(f"""
SELECT 'entity_f1' AS metric, round(f1, 9) AS value FROM ({SCORES['e11_entity_f1'].sql})
UNION ALL SELECT 'iob_word_f1', round(chrf, 7) FROM ({SCORES['e12_iob_word_f1'].sql})
UNION ALL SELECT 'chrf', round(chrf, 7) FROM ({_chrf_sql(_TAGGED_SQL, 6, 1.0)})""")
def e11_tag_files(spark, sf):
    rows = tagged_turns(spark, sf).withColumn("row", F.col("conv_id") * 1000 + F.col("turn"))
    scored = score_tag_files(spark, *_write_sides(spark, rows, "row"))
    digits = F.when(F.col("metric") == "entity_f1", F.round("value", 9)).otherwise(F.round("value", 7))
    return scored.withColumn("value", digits)


@QUERIES.add(f"WITH {_WORD_PAIRS_SQL} {_f1_sql('UAS', 'head', 'gold_head')} UNION ALL {_f1_sql('LAS', 'label', 'gold_label')}")
def e15_attachment_files(spark, sf):
    scored = score_dependency_files(spark, *_write_sides(spark, _dependency_predictions(spark, sf), "row_id"))
    return scored.withColumns({c: F.round(c, 7) for c in ("macro_f1", "micro_f1")})


@QUERIES.add(rf"""
SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_id, {_STUB_SQL} AS prediction
FROM (SELECT *, trim(text) AS t FROM conversations)""")
def p6_generate_lines(spark, sf):
    """A text file through a model to a text file in the same order."""
    source, out = scratch_path(spark, "in.txt"), scratch_path(spark, "out.txt")
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row"),
                                                    _one_line(F.col("text")).alias("line"))
    lines.write_lines(rows, source, "line", "row")
    generate_lines(spark, source, out, load_stub, 16)
    return lines.read_lines_indexed(spark, out).select("row_id", F.col("value").alias("prediction"))


@QUERIES.add(f"""
WITH numbered AS (SELECT lang AS text, source AS target_text, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)
SELECT '0:' || n AS row_id, text, target_text FROM numbered WHERE {sql_hash("'0:' || n", 7)} % 4 = 0
UNION ALL SELECT '1:' || n, text, target_text FROM numbered""")
def s18_sampled_sources(spark, sf):
    """The same pair files given twice: a fourth of them, and all of them."""
    path = scratch_path(spark, "pairs.tsv")
    rows = table(spark, sf, "documents").select("doc_id", F.array("lang", "source").alias("fields"))
    lines.write_lines(rows, path, "fields", "doc_id")
    files = f"{path}/part-*"
    return pairs.read_sources(spark, [(files, 4), files], seed=7)


_BATCH_TEXT_SQL = "regexp_replace(text, '[\\x09-\\x0D]+', ' ', 'g')"


@QUERIES.add(f"""
WITH d AS (SELECT doc_id, {_BATCH_TEXT_SQL} AS t, lang, source, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents),
keyed AS (
  SELECT '0:' || n AS row_id, t AS text, lang AS target FROM d WHERE {sql_hash("'0:' || n", 7)} % 4 = 0
  UNION ALL SELECT '1:' || n, t, source FROM d WHERE {sql_hash("'1:' || n", 7)} % 2 = 0),
kept AS (SELECT row_id, strlen(text) + 1 AS n_in, strlen(target) + 1 AS n_out FROM keyed WHERE strlen(text) + 1 + strlen(target) + 1 < 4096),
numbered AS (SELECT *, (row_number() OVER (ORDER BY ('0x' || substr(md5('0:' || row_id), 1, 13))::BIGINT, row_id) - 1) // 32 AS batch_id FROM kept)
SELECT batch_id, count(*) AS n_rows, max(n_in) AS input_width, max(n_out) AS label_width, sum(n_in)::BIGINT AS n_input_ids,
  sum(n_out)::BIGINT AS n_label_ids FROM numbered GROUP BY batch_id""", ints=("input_width", "label_width"))
def f14_sources_to_batches(spark, sf):
    """The training path: a sample of JSON lines and one of delimited pairs to full, padded batches."""
    text = F.regexp_replace("text", r"[\x09-\x0D]+", " ")
    rows = table(spark, sf, "documents").select("doc_id", text.alias("text"), "lang", "source")
    records, tsv = scratch_path(spark, "rows.jsonl"), scratch_path(spark, "rows.tsv")
    lines.write_lines(rows.select("doc_id", F.to_json(F.struct("text", F.col("lang").alias("label"))).alias("line")), records, "line", "doc_id")
    lines.write_lines(rows.select("doc_id", F.array("text", "source").alias("fields")), tsv, "fields", "doc_id")
    # Part files written as text don't tell that they hold records, so the kind is given.
    source = pairs.read_sources(spark, [(f"{records}/part-*", 4, "records"), (f"{tsv}/part-*", 2)], seed=7)
    ready = prepare("pairs", source, max_len=4096, encode=False)
    batches = pad_batch(ready, 32)
    return batches.groupBy("batch_id").agg(
        F.count("*").alias("n_rows"), F.max(F.size("input_ids")).alias("input_width"), F.max(F.size("labels")).alias("label_width"),
        F.sum(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x.cast("int"))).alias("n_input_ids"),
        F.sum(F.size(F.filter("labels", lambda x: x != 0))).alias("n_label_ids"))
