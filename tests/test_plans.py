import pytest
from pyspark.sql import functions as F

from textmill.functions import fixed_values as fv
from textmill.plans import evaluate
from textmill.plans.tasks import TASKS, assemble_splits, format_task, get_task, prepare
from textmill.session import scratch_path
from textmill.sources.lines import read_lines_indexed
from textmill.streaming.generate import read_line_stream, read_predictions, stream_generate

ANSWER = "array<struct<text:string,start_idx:int>>"
PARSE = "index array<int>, word_form array<string>, lemma array<string>, pos array<string>, head array<int>, deprel array<string>"
INPUTS = {
    "nsmc-naive": ("document string, label int", ("좋다", 0), "좋다", "positive"),
    "nsmc-prompted": ("document string, label int", ("좋다", 1), "nsmc sentiment classification: 좋다", "negative"),
    "klue-nli": ("premise string, hypothesis string, label int", ("a", "b", 1), "NLI, 전제: a\n가설: b\n", "모순"),
    "kornli-prompted": ("premise string, hypothesis string, label int", ("a", "b", 1), "NLI, 전제: a\n가설: b\n", "중립"),
    "klue-ynat": ("title string, label int", ("t", 6), "KLUE YNAT task: t\n", "정치"),
    "paws-x-kor": ("sentence1 string, sentence2 string, label int", ("a", "b", 1),
                   "paraphrase detection task:\n\nsentence-1: a\nsentence-2: b\n", "paraphrase"),
    "kr-internal": ("title string, content string, label int", ("t", "c", 0), "#TITLE t\n#CONTENT c", "first"),
    "kr-internal-mtl": ("title string, label int", ("t", 1), "Multitask classification:\n\nt", "second"),
    "klue-ner": ("tagged_sent string", ("<a:PS> b",), "task: NER\n\n### 입력\na b\n", "<a:PS> b"),
    "klue-dp": (f"sentence string, {PARSE}", ("s", [1], ["가나"], ["가 나"], ["NNG+JX"], [0], ["NP"]),
                "task: Dependency Parsing\n\nInput: s\nLemmas: 1/가나/2/가 나/NNG+JX/가:NNG/나:JX\n",
                "deprel: (1/2, 0, NP)\nword_counts: 1"),
    "korquad-v1": ("question string, context string, label string", ("q", "c", "ans"),
                   "task: MRC\n\nquestion: q\n\ncontext: c\n", "ans"),
    "hfdataset": ("text string, label string", ("a", "b"), "a", "b"),
    "jsonlines": ("text string, label string", ("a", "b"), "a", "b"),
    "anything else": ("text string, target_text string", ("a", "b"), "a", "b"),
}


@pytest.mark.parametrize("name", sorted(INPUTS))
def test_task_formats(spark, name):
    schema, values, input_text, target_text = INPUTS[name]
    df = spark.createDataFrame([(7, *values)], f"row_id long, {schema}")
    row = format_task(name, df, label_map={0: "first", 1: "second"}).first()
    assert (row.row_id, row.input_text, row.target_text) == (7, input_text, target_text)


def test_reading_task(spark):
    df = spark.createDataFrame([(i, "c", "q", [("x", 0), (f"답{i}", 1)], i % 2 == 0) for i in range(200)],
                               f"row_id long, context string, question string, answers {ANSWER}, plausible_answer boolean")
    rows = format_task("klue-mrc", df).collect()
    assert {r.input_text for r in rows} == {
        fv.MRC_INPUT.replace("{{ question }}", "q").replace("{{ context }}", "c")}
    for r in rows:
        last = r.target_text.split("\n")[1]
        answer = fv.UNKNOWN_ANSWER if r.row_id % 2 == 0 else f"답{r.row_id}"
        assert last == "정답임" or last == f"정답이 아님, 새 정답: {answer}"
    train = assemble_splits("klue-mrc", df, test=df.limit(10))
    counts = {r.split: r["count"] for r in train.groupBy("split").count().collect()}
    assert counts["validation"] == counts["test"] == 10 and 270 < counts["train"] < 330


def test_every_task_is_covered():
    assert set(TASKS) <= set(INPUTS) | {"klue-mrc"}
    assert len(TASKS) == 14
    assert get_task("klue-nli").gold_labels == {"함의": 0, "모순": 1, "중립": 2}


def test_splits_follow_what_is_given(spark):
    df = spark.createDataFrame([(i, f"text {i}", "y") for i in range(1000)], "row_id long, text string, target_text string")
    only_test = assemble_splits("tsv", None, test=df)
    assert {r.split for r in only_test.collect()} == {"test"}
    carved = assemble_splits("tsv", [df.filter("row_id < 500"), df.filter("row_id >= 500")], None, None, 0.1, 0.1)
    assert {r.split for r in carved.collect()} == {"train", "validation", "test"} and carved.count() == 1000
    given = assemble_splits("tsv", df, valid=df.limit(5), valid_proportion=0.5)
    assert given.filter("split = 'validation'").count() == 5
    with pytest.raises(ValueError):
        assemble_splits("tsv", None)


def test_prepare(spark):
    df = spark.createDataFrame([(i, "가" * i, "y") for i in range(20)], "row_id long, text string, target_text string")
    kept = prepare("tsv", df, max_len=20).collect()
    assert all(len(r.input_ids) + len(r.labels) < 20 for r in kept) and len(kept) == 6
    held = prepare("tsv", None, test=df, max_len=20).collect()
    assert len(held) == 20 and max(len(r.input_ids) for r in held) == 20
    topics = df.selectExpr("row_id", "text AS title", "0 AS label")
    assert prepare("klue-ynat", topics, max_len=20).count() == 20
    cut = prepare("tsv", df, max_len=20, truncate=True).collect()
    assert len(cut) == 20 and max(len(r.input_ids) for r in cut) == 20


def values(df):
    return {r.metric: r.value for r in df.collect()}


def test_evaluate_reading(spark):
    df = spark.createDataFrame([("출력: x\n정답이 아님, 새 정답: seoul", ["seoul"]), ("출력: y", ["[알 수 없음]"]),
                                ("출력: z\n정답임", ["other"])], "prediction string, gold array<string>")
    got = values(evaluate.evaluate_task("klue-mrc", df))
    assert got["exact_match"] == pytest.approx(2 / 3) and got["squad_exact_match"] == pytest.approx(200 / 3)
    assert got["rouge1"] == pytest.approx(1 / 3)
    keep = values(evaluate.evaluate_reading(df, golds="gold", on_missing="keep"))
    assert keep["exact_match"] == pytest.approx(1 / 3)


def test_evaluate_questions(spark):
    df = spark.createDataFrame([("‘서울’", ["서울"]), ("a b", ["b c"])], "prediction string, gold array<string>")
    got = values(evaluate.evaluate_task("korquad-v1", df))
    assert got["squad_exact_match"] == 50 and got["squad_f1"] == pytest.approx(100 * (1 + 2 / 3) / 2)


def test_evaluate_labels(spark):
    df = spark.createDataFrame([("함의", "함의"), ("함이", "함의"), ("중립", "모순")], "prediction string, gold string")
    assert values(evaluate.evaluate_task("klue-nli", df)) == {"accuracy": pytest.approx(2 / 3)}


def test_evaluate_texts(spark):
    df = spark.createDataFrame([("a b", "a b"), ("c d", "c e")], "prediction string, gold string")
    got = values(evaluate.evaluate_task("klue-ner", df))
    assert got["exact_match"] == 0.5 and got["rouge1"] == 0.75 and 0 < got["chrf"] < 100


def test_stream(spark):
    def load():
        return lambda texts: [t.upper() for t in texts]

    source, sink, progress = (scratch_path(spark, n) for n in ("in", "out", "progress"))
    spark.range(20).select(F.concat(F.lit(" line\\n"), F.col("id").cast("string")).alias("v")).write.text(source)
    for _ in range(2):
        stream_generate(read_line_stream(spark, source, 1), load, sink, progress, drain=True).awaitTermination()
    rows = spark.read.parquet(sink).collect()
    assert sorted(r.prediction for r in rows) == sorted(f"LINE{i}" for i in range(20))
    spark.range(3).select(F.lit("more").alias("v")).write.mode("append").text(source)
    stream_generate(read_line_stream(spark, source), load, sink, progress, drain=True).awaitTermination()
    assert spark.read.parquet(sink).count() == 23
    keyed = read_predictions(spark, sink).join(read_lines_indexed(spark, source), ["file_path", "line_no"]).collect()
    assert len(keyed) == 23 and all(r.value == r.input_text for r in keyed)
