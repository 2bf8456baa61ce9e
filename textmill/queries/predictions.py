"""Label repair, prediction parsing, alignment and model application."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.hashing import hash_bucket
from ..operators import labels, prediction
from ..operators.formatting import untag
from ..session import scratch_path
from ..sources.lines import read_lines_indexed
from ..streaming.generate import read_line_stream, read_predictions, stream_generate
from . import Registry, sql_hash, table, texts

QUERIES = Registry()
TYPES = ["ECONOMY", "MEDIUM", "LARGE", "SMALL", "PROMO", "STANDARD"]

_TYPO_SQL = f"""
SELECT p_partkey, p_type, CASE {sql_hash('p_partkey', 11)} % 6 WHEN 0 THEN substr(p_type, 2) WHEN 1 THEN p_type || 'S'
  WHEN 2 THEN left(p_type, 3) WHEN 3 THEN 'X' || substr(p_type, 3) ELSE p_type END AS pred FROM part"""
_NEAREST_SQL = f"""
SELECT pred, arg_min(label, levenshtein(pred, label) * 100 + place) AS nearest FROM (SELECT DISTINCT pred FROM ({_TYPO_SQL})),
  (SELECT unnest({TYPES}) AS label, unnest(range({len(TYPES)})) AS place) GROUP BY pred"""


def mistyped_parts(spark, sf):
    kind = F.col("p_type")
    draw = hash_bucket(F.col("p_partkey"), 6, 11)
    pred = (F.when(draw == 0, F.substr(kind, F.lit(2))).when(draw == 1, F.concat(kind, F.lit("S")))
            .when(draw == 2, F.substring(kind, 1, 3)).when(draw == 3, F.concat(F.lit("X"), F.substr(kind, F.lit(3))))
            .otherwise(kind))
    return table(spark, sf, "part").select("p_partkey", "p_type", pred.alias("pred"))


@QUERIES.add(f"SELECT pred AS label, count(*) AS n FROM ({_TYPO_SQL}) GROUP BY pred")
def p1_label_counts(spark, sf):
    return labels.count_labels(mistyped_parts(spark, sf), "pred")


@QUERIES.add("SELECT w AS label, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY w")
def p1_label_counts_nested(spark, sf):
    """Lists of labels are flattened first."""
    return labels.count_labels(texts(spark, sf, "documents").select(F.split("text", " ", -1).alias("w")), "w")


@QUERIES.add(f"""
SELECT pred AS label, nearest AS corrected, count(*) AS n FROM ({_TYPO_SQL}) JOIN ({_NEAREST_SQL}) USING (pred)
WHERE pred <> nearest GROUP BY ALL""")
def p2_correction_map(spark, sf):
    return labels.correction_map(mistyped_parts(spark, sf), "pred", TYPES)


@QUERIES.add(f"SELECT p_partkey, nearest AS corrected FROM ({_TYPO_SQL}) JOIN ({_NEAREST_SQL}) USING (pred)")
def p3_apply_correction(spark, sf):
    return labels.apply_correction(mistyped_parts(spark, sf), "pred", TYPES, "corrected").select("p_partkey", "corrected")


_NAME_TYPO_SQL = f"""
SELECT c_custkey, CASE {sql_hash('c_custkey', 12)} % 48 WHEN 0 THEN substr(c_name, 2) WHEN 1 THEN c_name || '0' WHEN 2 THEN reverse(c_name)
  WHEN 3 THEN 'K' || substr(c_name, 2, 8) || '9' || substr(c_name, 11) WHEN 4 THEN substr(c_name, 10) ELSE c_name END AS pred FROM customer"""
_NAME_NEAREST_SQL = f"""
SELECT pred, arg_min(c_name, levenshtein(pred, c_name) * 1000000000 + c_custkey) AS nearest
FROM (SELECT DISTINCT pred FROM ({_NAME_TYPO_SQL}) WHERE pred NOT IN (SELECT c_name FROM customer)), customer GROUP BY pred"""


def mistyped_names(spark, sf):
    """Customer names, a tenth of them mistyped, some beyond any label's reach; and the table of all names as labels."""
    customers = table(spark, sf, "customer")
    name = F.col("c_name")
    draw = hash_bucket(F.col("c_custkey"), 48, 12)
    pred = (F.when(draw == 0, F.substr(name, F.lit(2))).when(draw == 1, F.concat(name, F.lit("0"))).when(draw == 2, F.reverse(name))
            .when(draw == 3, F.concat(F.lit("K"), F.substring(name, 2, 8), F.lit("9"), F.substr(name, F.lit(11))))
            .when(draw == 4, F.substr(name, F.lit(10))).otherwise(name))
    return (customers.select("c_custkey", pred.alias("pred")),
            customers.select(name.alias("label"), F.col("c_custkey").alias("place")))


@QUERIES.add(f"SELECT pred AS label, nearest AS corrected, count(*) AS n FROM ({_NAME_TYPO_SQL}) JOIN ({_NAME_NEAREST_SQL}) USING (pred) GROUP BY ALL")
def p2_correction_index(spark, sf):
    """As many labels as customers, by an index."""
    rows, names = mistyped_names(spark, sf)
    return labels.correction_map(rows, "pred", names)


@QUERIES.add(f"SELECT c_custkey, coalesce(nearest, pred) AS corrected FROM ({_NAME_TYPO_SQL}) LEFT JOIN ({_NAME_NEAREST_SQL}) USING (pred)")
def p3_correction_index(spark, sf):
    rows, names = mistyped_names(spark, sf)
    return labels.apply_correction(rows, "pred", names, "corrected").select("c_custkey", "corrected")


@QUERIES.add(f"""
SELECT p_partkey, CASE WHEN list_contains({TYPES}, pred) THEN list_position({TYPES}, pred) - 1 END AS pred_id
FROM ({_TYPO_SQL})""")
def j3_label_ids(spark, sf):
    ids = {name: i for i, name in enumerate(TYPES)}
    return labels.lookup_label_id(mistyped_parts(spark, sf), "pred", ids, "pred_id").select("p_partkey", "pred_id")


_READING_SQL = """
SELECT conv_id, turn, w[1] AS a, coalesce(w[2], '') AS b, (conv_id + turn) % 5 AS k
FROM (SELECT *, string_split(replace(text, chr(10), ' '), ' ') AS w FROM conversations)"""


def reading_predictions(spark, sf):
    words = F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " ", -1)
    first, second = words[0], F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    k = (F.col("conv_id") + F.col("turn")) % 5
    start = F.concat(F.lit(fv.OUTPUT_PREFIX), first)
    text = (F.when(k == 0, start)
            .when(k == 1, F.concat(start, F.lit("\n정답이 아님"), F.lit(fv.NEW_ANSWER_MARK), second))
            .when(k == 2, F.concat(start, F.lit("\n정답이 아님 / "), second))
            .when(k == 3, F.concat(start, F.lit("\n정답이 아님, 새 정답: x, 새 정답: "), second))
            .otherwise(F.concat(start, F.lit("\n정답임"))))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.alias("prediction"))


def _parse_sql(missing: str) -> str:
    return f"""
SELECT conv_id, turn, CASE k WHEN 0 THEN {missing} WHEN 1 THEN b WHEN 2 THEN '/ ' || b WHEN 3 THEN b ELSE a END AS answer
FROM ({_READING_SQL})"""


@QUERIES.add(_parse_sql("'[알 수 없음]'"))
def p4_parse_reading(spark, sf):
    return reading_predictions(spark, sf).select(
        "conv_id", "turn", prediction.parse_reading_prediction(F.col("prediction")).alias("answer"))


@QUERIES.add(_parse_sql("a"))
def p4_parse_reading_keep(spark, sf):
    return reading_predictions(spark, sf).select(
        "conv_id", "turn", prediction.parse_reading_prediction(F.col("prediction"), "keep").alias("answer"))


@QUERIES.add("SELECT doc_id AS row_id, lang AS prediction, quality AS gold FROM documents JOIN labels USING (doc_id)")
def p5_align(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("lang").alias("prediction"))
    golds = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("gold"))
    return prediction.align(docs, golds)


@QUERIES.add("""
SELECT count(*) FILTER (d.doc_id = l.doc_id) AS n_both, count(*) FILTER (l.doc_id IS NULL) AS n_only_predicted,
  count(*) FILTER (d.doc_id IS NULL) AS n_only_gold, 0::BIGINT AS n_repeated FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def p5_alignment_report(spark, sf):
    return prediction.alignment_report(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@QUERIES.add("""
SELECT l.doc_id AS qid, quality, lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id AND d.lang <> 'fr'""")
def j2_lookup_by_id(spark, sf):
    answers = table(spark, sf, "documents").filter("lang <> 'fr'").select(F.col("doc_id").alias("qid"), "lang")
    golds = table(spark, sf, "labels").select(F.col("doc_id").alias("qid"), "quality")
    return prediction.lookup_by_id(golds, answers)


def load_stub():
    """Stands for a model: the length of the text and its first three words."""
    def predict(texts: list[str]) -> list[str]:
        return [f"{len(t)} {' '.join(t.split(' ')[:3])}\n" for t in texts]

    return predict


_STUB_SQL = r"""length(t) || ' ' || regexp_replace(replace(array_to_string(string_split(t, ' ')[1:3], ' '), E'\n', ''),
  '\s+$', '')"""


def _one_line(column):
    return F.replace(column, F.lit("\n"), F.lit("\\n"))


@QUERIES.add(f"SELECT conv_id, turn, {_STUB_SQL} AS prediction FROM (SELECT *, trim(text) AS t FROM conversations)")
def p6_batch_generate(spark, sf):
    rows = texts(spark, sf, "conversations").select("conv_id", "turn", _one_line(F.col("text")).alias("input_text"))
    return prediction.batch_generate(rows, load_stub, 16).select("conv_id", "turn", "prediction")


@QUERIES.add(rf"""
SELECT replace(text, E'\n', '\n') AS input_text, {_STUB_SQL} AS prediction
FROM (SELECT *, trim(text) AS t FROM conversations)""")
def p7_stream_generate(spark, sf):
    source, sink = scratch_path(spark, "lines"), scratch_path(spark, "scored")
    table(spark, sf, "conversations").select(_one_line(F.col("text"))).write.text(source)
    lines = read_line_stream(spark, source)
    stream_generate(lines, load_stub, sink, scratch_path(spark, "progress"), 16, drain=True).awaitTermination()
    return spark.read.parquet(sink).select("input_text", "prediction")


@QUERIES.add(rf"""
SELECT replace(text, E'\n', '\n') AS gold, {_STUB_SQL} AS prediction
FROM (SELECT *, trim(text) AS t FROM conversations)""")
def p7_stream_aligned(spark, sf):
    """Predictions of a stream, beside the lines of the same file and number read as a table."""
    source, sink = scratch_path(spark, "lines"), scratch_path(spark, "scored")
    table(spark, sf, "conversations").select(_one_line(F.col("text"))).write.text(source)
    lines = read_line_stream(spark, source)
    stream_generate(lines, load_stub, sink, scratch_path(spark, "progress"), 16, drain=True).awaitTermination()
    golds = read_lines_indexed(spark, source).withColumnRenamed("value", "gold")
    return read_predictions(spark, sink).join(golds, ["file_path", "line_no"]).select("gold", "prediction")


_TAG_SQL = r"""SELECT item_id, regexp_replace(text, '([A-Z][a-z]+)', '<\1:PS>', 'g') AS tagged, text FROM benchmark"""


def _tagged(spark, sf):
    tagged = F.regexp_replace("text", "([A-Z][a-z]+)", "<$1:PS>")
    return table(spark, sf, "benchmark").select("item_id", tagged.alias("tagged"))


@QUERIES.add(rf"""
WITH RECURSIVE w AS (SELECT item_id, unnest(e) AS word, generate_subscripts(e, 1) AS k
  FROM (SELECT item_id, regexp_extract_all(text, '[A-Z][a-z]+') AS e FROM benchmark)),
r AS (SELECT item_id, 0::BIGINT AS k, text, 0::BIGINT AS cursor FROM benchmark
  UNION ALL SELECT r.item_id, w.k, left(r.text, r.cursor + instr(substr(r.text, r.cursor + 1), word) - 1) || '<' || word
      || ':PS>' || substr(r.text, r.cursor + instr(substr(r.text, r.cursor + 1), word) + length(word)),
    r.cursor + instr(substr(r.text, r.cursor + 1), word) - 1 + length(word) + 5
  FROM r JOIN w ON w.item_id = r.item_id AND w.k = r.k + 1)
SELECT item_id, arg_max(text, k) AS tagged FROM r GROUP BY item_id""")
def p9_retag(spark, sf):
    tags = F.array_join(F.regexp_extract_all("tagged", F.lit("<.+?:[A-Z][A-Z]>"), 0), " ")
    rows = _tagged(spark, sf).select("item_id", untag(F.col("tagged")).alias("plain"), tags.alias("tags"))
    again = prediction.retag_sentence(F.col("plain"), prediction.label_elements(F.col("tags")), boundary_rule=False)
    return rows.select("item_id", again.alias("tagged"))


def _find_sql(start: str) -> str:
    rest = f"substr(text, ({start}) + 1)"
    return f"CASE WHEN instr({rest}, word) > 0 THEN ({start}) + instr({rest}, word) - 1 ELSE -1 END"


_BOUNDARY_SQL = ", ".join("'" + c.replace("'", "''") + "'" for c in fv.TAG_BOUNDARY_CHARACTERS)


def _loose_sql(at: str) -> str:
    """The character before a place is no boundary; places before the text count from its end."""
    return f"(substr(text, CASE WHEN {at} > 0 THEN {at} ELSE length(text) + {at} END, 1) NOT IN ({_BOUNDARY_SQL}))"


def _retag_sql(text: str, words: str) -> str:
    return rf"""
WITH RECURSIVE b AS (SELECT item_id, {text} AS text FROM benchmark),
w AS (SELECT item_id, unnest(e) AS word, generate_subscripts(e, 1) AS k
  FROM (SELECT item_id, regexp_extract_all(text, '{words}') AS e FROM b)),
r AS (SELECT item_id, 0::BIGINT AS k, text, 0::BIGINT AS cursor FROM b
  UNION ALL SELECT item_id, k,
    CASE WHEN spot >= 0 THEN left(text, spot) || '<' || word || ':PS>' || substr(text, spot + length(word) + 1) ELSE text END,
    CASE WHEN spot >= 0 THEN spot + length(word) + 5 ELSE cursor END
  FROM (SELECT *, CASE WHEN NOT unsure THEN a1 WHEN NOT {_loose_sql('a2')} THEN a2
        WHEN cursor + a2 < 0 THEN {_find_sql('greatest(0, length(text) + cursor + a2)')} ELSE {_find_sql('cursor + a2')} END AS spot
    FROM (SELECT *, {_find_sql('cursor + a1')} AS a2, a1 > 0 AND {_loose_sql('a1')}
        AND (length(substr(text, cursor + 1)) - length(replace(substr(text, cursor + 1), word, ''))) // length(word) > 1 AS unsure
      FROM (SELECT *, {_find_sql('cursor')} AS a1 FROM (
        SELECT r.item_id, w.k, r.text, r.cursor, w.word FROM r JOIN w ON w.item_id = r.item_id AND w.k = r.k + 1)))))
SELECT item_id, arg_max(text, k) AS tagged FROM r GROUP BY item_id"""


@QUERIES.add(_retag_sql("lower(text)", "[a-z]{2,3}"))
def p9_retag_inside_words(spark, sf):
    """Short strings of a lower-case text, most of which also occur inside other words, so that searches are repeated and fail."""
    text = F.lower("text")
    found = F.regexp_extract_all(text, F.lit("[a-z]{2,3}"), 0)
    elements = F.transform(found, lambda w: F.concat(F.lit("<"), w, F.lit(":PS>")))
    rows = table(spark, sf, "benchmark").select("item_id", prediction.retag_sentence(text, elements).alias("tagged"))
    return rows


@QUERIES.add(_retag_sql("text", "[A-Z][a-z]+"))
def p9_retag_boundary(spark, sf):
    """With the boundary rule for words that occur more than once."""
    tags = F.array_join(F.regexp_extract_all("tagged", F.lit("<.+?:[A-Z][A-Z]>"), 0), " ")
    rows = _tagged(spark, sf).select("item_id", untag(F.col("tagged")).alias("plain"), tags.alias("tags"))
    again = prediction.retag_sentence(F.col("plain"), prediction.label_elements(F.col("tags")))
    return rows.select("item_id", again.alias("tagged"))


@QUERIES.add(f"""
SELECT conv_id, turn, CASE WHEN {sql_hash('conv_id * 1000 + turn', 5)} % 3 = 0 THEN '[알 수 없음]' ELSE w[1] END AS first_text,
  CASE WHEN {sql_hash('conv_id * 1000 + turn', 5)} % 3 = 0 THEN -1 ELSE 0 END AS first_start,
  CASE WHEN {sql_hash('conv_id * 1000 + turn', 5)} % 3 = 0 THEN 1 ELSE len(w) END AS n_answers
FROM (SELECT *, string_split(text, ' ') AS w FROM conversations)""", ints=("n_answers",))
def p10_gold_answers(spark, sf):
    key = F.col("conv_id") * 1000 + F.col("turn")
    answers = F.transform(F.split("text", " ", -1), lambda w, i: F.struct(w.alias("text"), i.alias("start_idx")))
    golds = prediction.gold_answers(hash_bucket(key, 3, 5) == 0, answers)
    rows = table(spark, sf, "conversations").select("conv_id", "turn", golds.alias("golds"))
    return rows.select("conv_id", "turn", F.col("golds")[0]["text"].alias("first_text"),
                       F.col("golds")[0]["answer_start"].alias("first_start"), F.size("golds").alias("n_answers"))
