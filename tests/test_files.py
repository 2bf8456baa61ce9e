import os

import pytest

from textmill.plans import files
from textmill.sources.lines import read_lines_indexed, read_prediction_records


def put(folder, name, rows):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as out:
        out.write("\n".join(rows) + "\n")
    return path


def test_label_files(spark, folder):
    gold = put(folder, "gold", ["b", "a", "b", "c"])
    pred = put(folder, "pred", ["b ", "b", "zzz", "c"])
    report = {r.label: r for r in files.score_label_files(spark, pred, gold).collect() if r.kind == "class"}
    assert [report[x].first_row for x in "bac"] == [0, 1, 3]
    assert report["b"].precision == 0.5 and report["b"].recall == 0.5
    compat = {r.label: r for r in files.score_label_files(spark, pred, gold, compat=True).collect()}
    assert compat["b"].recall == 1.0
    with pytest.raises(Exception, match="without counterpart"):
        files.score_label_files(spark, put(folder, "short", ["b"]), gold).collect()


def test_tag_files(spark, folder):
    gold = put(folder, "gold", ["<가:PS> x", "<나:LC>"])
    same = {r.metric: r.value for r in files.score_tag_files(spark, gold, gold).collect()}
    assert same["entity_f1"] == pytest.approx(1) and same["chrf"] == pytest.approx(100)
    assert same["iob_word_f1"] == pytest.approx(100)


def test_dependency_files(spark, folder):
    gold = put(folder, "gold", ["deprel: (1/2, 2, NP)▁(2/1, 0, VP)", "word_counts: 2", "deprel: (1/1, 0, VP)", "word_counts: 1"])
    pred = put(folder, "pred", ["deprel: (1/2, 2, NP)▁(2/1, 1, VP)", "deprel: (1/1, 0, VP)", "word_counts: 1"])
    scores = {r.score: r for r in files.score_dependency_files(spark, pred, gold).collect()}
    assert scores["UAS"].micro_f1 == pytest.approx(200 / 3) and scores["LAS"].micro_f1 == pytest.approx(200 / 3)


def test_reading_file(spark, folder):
    path = put(folder, "pred", ["출력: 서울", "정답임", "출력: a", "정답이 아님, 새 정답: b", "출력: 부산"])
    records = read_prediction_records(spark, path).orderBy("row_id").collect()
    assert [r.prediction for r in records] == ["출력: 서울\n정답임", "출력: a\n정답이 아님, 새 정답: b", "출력: 부산"]
    golds = spark.createDataFrame([(0, ["서울"]), (1, ["b"]), (2, ["부산"])], "row_id long, golds array<string>")
    scores = {r.metric: r.value for r in files.score_reading_file(spark, path, golds).collect()}
    assert scores["exact_match"] == 1.0 and scores["squad_f1"] == 100


def test_generate_lines(spark, folder):
    def load():
        return lambda texts: [t.replace("\n", "|") + "\n!" for t in texts]

    source = put(folder, "in", [f" line\\n{i} " for i in range(100)])
    files.generate_lines(spark, source, f"{folder}/out", load, 7)
    rows = read_lines_indexed(spark, f"{folder}/out").orderBy("row_id").collect()
    assert [r.value for r in rows] == [f"line|{i}!" for i in range(100)]
