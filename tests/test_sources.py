import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from textmill.functions import fixed_values as fv
from textmill.session import scratch_path, shared_dir
from textmill.operators import tokens
from textmill.sources import benchmarks, lines, pairs, questions


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)
    return path


def test_tsv_pairs(spark, folder):
    path = put(folder, "pairs.tsv", 'a\tb\n one \ttwo\\nlines\t \nonly\nx\ty\tz\nempty\t\n"q\tr\n')
    good = pairs.read_tsv_pairs(spark, path, with_row_id=True).orderBy("line_no").collect()
    assert [(r.line_no, r.text, r.target_text) for r in good] == [
        (0, "a", "b"), (1, "one ", "two\nlines"), (5, '"q', "r")]
    bad = pairs.rejected_pairs(spark.read.text(path)).collect()
    assert sorted((r.value, r.field_count) for r in bad) == [("empty\t", 1), ("only", 1), ("x\ty\tz", 3)]


def test_jsonl_pairs(spark, folder):
    rows = [{"text": "a", "label": "b"}, {"text": " ", "label": "b"}, {"text": "a", "label": ""}, {"text": "a"}]
    path = put(folder, "pairs.jsonl", "\n".join(json.dumps(r) for r in rows))
    assert [tuple(r) for r in pairs.read_jsonl_pairs(spark, path).collect()] == [("a", "b")]


def test_compressed_records(spark, folder):
    zstandard = pytest.importorskip("zstandard")
    text = "\n".join(json.dumps({"text1": f"t{i}"}) for i in range(5)).encode()
    for name, data in (("d.jsonl.gz", gzip.compress(text)), ("d.jsonl.zst", zstandard.ZstdCompressor().compress(text))):
        path = os.path.join(folder, name)
        with open(path, "wb") as out:
            out.write(data)
        rows = pairs.read_json_records(spark, path, "text1 string", partitions=4)
        assert rows.rdd.getNumPartitions() == 4
        assert sorted(r.text1 for r in rows.collect()) == [f"t{i}" for i in range(5)]


def test_read_any_dispatch(spark, folder):
    tsv = put(folder, "p.tsv", "a\tb\n")
    saved = os.path.join(folder, "saved")
    spark.createDataFrame([("x", "train"), ("y", "test")], "text string, split string").transform(
        lambda df: pairs.write_splits(df, saved) or df)
    spark.range(3).createOrReplaceTempView("named_rows")
    assert pairs.read_any(spark, tsv).first().target_text == "b"
    assert pairs.read_any(spark, saved).count() == 2
    assert pairs.read_split(spark, saved, "test").first().text == "y"
    assert pairs.read_any(spark, "named_rows").count() == 3


def test_sampled_sources(spark, folder):
    tsv = put(folder, "p.tsv", "".join("same\tpair\n" for _ in range(400)))
    saved = os.path.join(folder, "saved")
    spark.range(300).selectExpr("'x' AS text", "'y' AS target_text").write.parquet(saved)
    spark.range(5).selectExpr("id AS row_id", "'t' AS text", "'u' AS target_text").createOrReplaceTempView("keyed_rows")
    rows = pairs.read_sources(spark, [(tsv, 4), (saved, 3), "keyed_rows"], seed=1)
    counts = {r.text: r["count"] for r in rows.groupBy("text").count().collect()}
    assert 60 < counts["same"] < 140 and 65 < counts["x"] < 135 and counts["t"] == 5
    assert rows.select("row_id").distinct().count() == rows.count()
    again = pairs.read_sources(spark, [(tsv, 4), (saved, 3), "keyed_rows"], seed=1)
    assert set(map(tuple, rows.collect())) == set(map(tuple, again.collect()))


def test_sources_of_all_kinds_have_unique_keys(spark, folder):
    saved = os.path.join(folder, "splits")
    frame = spark.range(90, numPartitions=1).selectExpr("concat('t', id) AS text", "'u' AS target_text",
                                                        "array('train', 'validation', 'test')[id % 3] AS split")
    pairs.write_splits(frame, saved)
    rows = pairs.read_sources(spark, [saved], seed=1)
    assert rows.count() == rows.select("row_id").distinct().count() == 90
    records = os.path.join(folder, "records")
    spark.range(40).selectExpr("concat('r', id) AS text", "IF(id % 4 = 0, '', 'l') AS label").write.json(records)
    tsv = os.path.join(folder, "lines")
    spark.range(25).selectExpr("concat('p', id, '\t', 'q')").write.text(tsv)
    assert [pairs.source_kind(spark, x) for x in (saved, records, tsv, "x*.jsonl.bz2", "y?.tsv.gz", "[ab].parquet", "none")] == [
        "saved", "records", "pairs", "records", "pairs", "saved", "table"]
    assert pairs.read_any(spark, records).count() == 30 and pairs.read_any(spark, tsv).count() == 25
    both = pairs.read_sources(spark, [(records, 1), tsv], seed=1)
    assert both.columns == ["row_id", "text", "target_text"]
    assert both.count() == both.select("row_id").distinct().count() == 55
    batches = tokens.pad_batch(both.withColumnsRenamed({"text": "input_text"}), 10)
    assert sorted(r["count"] for r in batches.groupBy("batch_id").count().collect()) == [5, 10, 10, 10, 10, 10]


def test_dense_numbers_of_sparse_keys(spark):
    rows = spark.range(1000).selectExpr("id * id * 1000003 - 5000 AS k", "id")
    found = {r.id: r.row_id for r in lines.dense_index(rows, "k", block_rows=64).collect()}
    assert found == {i: i for i in range(1000)}
    assert lines.dense_index(rows.limit(0), "k").count() == 0


def test_line_numbers_over_splits_and_files(spark, folder):
    expected = []
    for name in ("a.txt", "b.txt"):
        rows = [f"{name} line {i} " + "x" * (i % 50) for i in range(700)]
        put(folder, name, "\n".join(rows) + "\n")
        expected += rows
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        read = lines.read_lines_indexed(spark, folder)
        assert read.select(F.spark_partition_id()).distinct().count() > 4
        rows = sorted(read.collect(), key=lambda r: r.row_id)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.value for r in rows] == expected
    assert [r.row_id for r in rows] == list(range(1400))
    assert [r.line_no for r in rows] == list(range(700)) * 2


def test_dense_index(spark):
    df = spark.range(0, 5000, 7).withColumn("g", F.col("id") % 3)
    whole = lines.dense_index(df, "id", block_rows=64).orderBy("id").collect()
    assert [r.row_id for r in whole] == list(range(len(whole)))
    parts = lines.dense_index(df, "id", within="g", block_rows=64).collect()
    for g in range(3):
        mine = sorted((r.id, r.row_id) for r in parts if r.g == g)
        assert [n for _, n in mine] == list(range(len(mine)))


def test_write_lines_keeps_order(spark, folder):
    path = os.path.join(folder, "out")
    rows = spark.range(500).select("id", F.array(F.lit("a"), F.col("id").cast("string")).alias("items"))
    lines.write_lines(rows.repartition(7), path, "items", "id")
    back = lines.read_lines_indexed(spark, path).orderBy("row_id").collect()
    assert [r.value for r in back] == [f"a\t{i}" for i in range(500)]


def test_answer_map(spark, folder):
    path = os.path.join(folder, "answers")
    df = spark.createDataFrame([("q1", '"x"\n'), ("q2", "y")], "id string, prediction_text string")
    lines.write_answer_map(df, path)
    assert sorted(map(tuple, lines.read_answer_map(spark, path).collect())) == [("q1", '"x"\n'), ("q2", "y")]


def test_benchmark_records(spark, folder):
    entity = {"word": "w", "start_idx": 1, "end_idx": 2}
    put(folder, "re.json", json.dumps([{"sentence": "s", "subject_entity": entity, "object_entity": entity,
                                        "label": "b"}]))
    row = benchmarks.read_benchmark_json(spark, "re", f"{folder}/re.json", relations=["a", "b"]).first()
    assert (row.sentence, row.subject.text, row.object.end, row.label, row.record_no) == ("s", "w", 2, 1, 0)
    put(folder, "ynat.json", json.dumps([{"title": t, "label": t} for t in fv.TOPIC_CLASSES]))
    rows = benchmarks.read_benchmark_json(spark, "ynat", f"{folder}/ynat.json").orderBy("record_no").collect()
    assert [r.label for r in rows] == list(range(7))
    put(folder, "sts.json", json.dumps([{"sentence1": "a", "sentence2": "b",
                                         "labels": {"label": 3.5, "real-label": 3.4, "binary-label": 1}}]))
    labels = benchmarks.read_benchmark_json(spark, "sts", f"{folder}/sts.json").first().labels
    assert (labels.label, round(labels.real_label, 3), labels.binary_label) == (3.5, 3.4, 1)


def test_benchmark_folder(spark, folder):
    os.makedirs(f"{folder}/klue-nli-v1.1")
    for part, label in (("train", "neutral"), ("dev", "entailment")):
        put(folder, f"klue-nli-v1.1/klue-nli-v1.1_{part}.json",
            json.dumps([{"premise": part, "hypothesis": "h", "gold_label": label}]))
    rows = benchmarks.read_benchmark(spark, "nli", folder).collect()
    assert sorted((r.premise, r.label, r.split) for r in rows) == [("dev", 0, "test"), ("train", 2, "train")]
    assert list(benchmarks.benchmark_files("ynat-aeda", "d")) == ["train"]


def test_unknown_class_fails(spark, folder):
    path = put(folder, "bad.json", json.dumps([{"title": "t", "label": "nothing"}]))
    with pytest.raises(Exception, match="no label entry"):
        benchmarks.read_benchmark_json(spark, "ynat", path).collect()


def test_reading_questions(spark, folder):
    def answer(text, start):
        return {"text": text, "answer_start": start}

    qas = [{"guid": "q0", "question": "a?", "answers": [answer("x", 1), answer("y", 2)]},
           {"guid": "q1", "question": "b?", "answers": [], "plausible_answers": [answer("z", 3)]},
           {"guid": "q2", "question": "c?", "answers": []}]
    path = put(folder, "mrc.json", json.dumps({"data": [{"title": "t", "paragraphs": [{"context": "c", "qas": qas}]}]}))
    rows = {r.qid: r for r in benchmarks.read_reading_questions(spark, path).collect()}
    assert [(a.text, a.start_idx) for a in rows["q0"].answers] == [("x", 1), ("y", 2)]
    assert rows["q1"].plausible_answer and rows["q1"].answers[0].text == "z"
    assert not rows["q2"].plausible_answer and rows["q2"].answers == []


def test_dialogue_records(spark, folder):
    dialogue = [{"role": "user", "text": "u0", "state": ["a"]}, {"role": "sys", "text": "s0"},
                {"role": "user", "text": "u1", "state": ["a", "b"]}, {"role": "sys", "text": "s1"}]
    path = put(folder, "wos.json", json.dumps([{"domains": ["d"], "dialogue": dialogue}]))
    rows = benchmarks.read_dialogue_states(spark, path).orderBy("turn_no").collect()
    assert [(r.sys_text, r.prev_state, r.label_state, len(r.dialogue)) for r in rows] == [
        ("s0", [], ["a"], 1), ("s1", ["a"], ["a", "b"], 3)]


def test_ner_blocks(spark, folder):
    path = put(folder, "ner.tsv",
               "## klue-ner-v1_dev_0-a\t<가나:PS> 다\n가\tB-PS\n나\tI-PS\n \tO\n다\tO\n\n## klue-ner-v1_dev_1-a\tx\nx\tO\n")
    rows = benchmarks.read_ner_blocks(spark, path).orderBy("block_no").collect()
    assert rows[0].sentence == ["가", "나", "", "다"] and rows[0].labels == [1, 2, 0, 0]
    assert rows[0].tagged_sent == "<가나:PS> 다"
    assert rows[1].sentence == ["x"]


def test_ner_blocks_with_carriage_returns(spark, folder):
    path = os.path.join(folder, "ner.tsv")
    with open(path, "wb") as out:
        out.write("## klue-ner-0\tx y\r\nx\tO\r\n\r\n## klue-ner-1\tz\r\nz\tB-PS\r\n".encode())
    for newline in ("\r\n", None):
        rows = benchmarks.read_ner_blocks(spark, path, newline=newline).orderBy("block_no").collect()
        assert [(r.sentence, r.labels, r.tagged_sent) for r in rows] == [(["x"], [0], "x y"), (["z"], [1], "z")]
    with pytest.raises(Exception, match="two line endings"):
        benchmarks.read_ner_blocks(spark, path, newline="\n").collect()
    unknown = put(folder, "unknown.tsv", "## klue-ner-0\tx\nx\tB-XX\n")
    with pytest.raises(Exception, match="unknown tag"):
        benchmarks.read_ner_blocks(spark, unknown).collect()


def test_dependency_blocks(spark, folder):
    header = "".join(f"## heading {i}\n" for i in range(5))
    body = "## d-0\t나는 간다\n1\t나는\t나 는\tNP+JX\t2\tNP_SBJ\n2\t간다\t가 ㄴ다\tVV+EF\t0\tVP\nbroken\tline\n"
    path = put(folder, "dp.tsv", header + body + "\n## d-1\t끝\n1\t끝\t끝\tNNG\t0\tNP")
    rows = benchmarks.read_dependency_sentences(spark, path).orderBy("block_no").collect()
    assert [r.sentence for r in rows] == ["나는 간다", "끝"]
    assert rows[0]["index"] == [1, 2] and rows[0].head == [2, 0] and rows[0].deprel == ["NP_SBJ", "VP"]
    assert [r.words for r in benchmarks.read_dependency_blocks(spark, path).orderBy("block_no").collect()] == [
        ["나는", "간다"], ["끝"]]


def test_nli_and_sts_tables(spark, folder):
    nli = put(folder, "nli.tsv", 'sentence1\tsentence2\tgold_label\n"a\tb\tneutral\nx\t\tneutral\n')
    assert [tuple(r) for r in benchmarks.read_nli_table(spark, nli).collect()] == [('"a', "b", 1)]
    sts = put(folder, "sts.tsv", "genre\tfilename\tyear\tid\tscore\tsentence1\tsentence2\nmain-forum\tMSRvid\t2012train\t3\t4.5\ta\tb\n")
    assert tuple(benchmarks.read_sts_table(spark, sts).first()) == (2, 2, 3, 3, 4.5, "a", "b")
    both = benchmarks.read_table_splits(spark, "nli", {"train": nli, "test": nli})
    assert {(r.premise, r.label, r.split) for r in both.collect()} == {('"a', 1, "train"), ('"a', 1, "test")}
    with pytest.raises(Exception, match="no label entry"):
        benchmarks.read_sts_table(spark, put(folder, "odd.tsv", "genre\tfilename\tyear\tid\tscore\tsentence1\tsentence2\nx\tMSRvid\t2017\t3\t4.5\ta\tb\n")).collect()


def test_class_tables(spark, folder):
    relations = put(folder, "relation_list.json", '{"relations": ["no_relation", "org:founded"]}')
    ontology = put(folder, "ontology.json", '{"hotel-area": ["a", "b"],\n "hotel-name": []}')
    assert benchmarks.read_class_names(spark, relations, "re") == ["no_relation", "org:founded"]
    assert benchmarks.read_class_names(spark, ontology, "wos") == ["hotel-area", "hotel-name"]


def test_flatten_questions(spark, folder):
    context = "Ab c. De f! Gh"
    answers = [{"text": "De", "answer_start": context.index("De")}, {"text": "e f", "answer_start": 7}]
    document = {"version": "1", "data": [{"title": "t", "paragraphs": [
        {"context": context, "qas": [{"id": "q", "question": "?", "answers": answers}]}]}]}
    path = put(folder, "q.json", json.dumps(document))
    row = questions.read_nested_questions(spark, path).first()
    assert [p.sent for p in row.position] == ["De f!", "De f!"] and row.label == ["De", "e f"]
    strict = questions.read_nested_questions(spark, path, compat=True).first()
    # The running offset of the strict rule is one less per cut, and a sentence start does not count as inside.
    assert [p.sent for p in strict.position] == ["De f!", "De f!"]
    at_start = {"version": "1", "data": [{"title": "t", "paragraphs": [{"context": context, "qas": [
        {"id": "q", "question": "?", "answers": [{"text": "Ab", "answer_start": 0}]}]}]}]}
    path = put(folder, "q2.json", json.dumps(at_start))
    assert questions.read_nested_questions(spark, path).first().position[0].sent == "Ab c."
    assert questions.read_nested_questions(spark, path, compat=True).first().position[0].sent == ""
    flat = questions.shape_flat_questions(questions.read_nested_questions(spark, path)).first()
    assert (flat.context, flat.label) == (context, "Ab")


def test_shared_folder_comes_from_the_session(spark):
    assert spark.conf.get("spark.checkpoint.dir", None) in (None, shared_dir(spark))
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_blocks_are_balanced_whatever_the_values(spark):
    ids = spark.range(100_000).select(F.col("id"))
    tables = {
        "outlier": ids.union(spark.createDataFrame([(1 << 60,)], "id long")),
        "both ends": ids.union(spark.createDataFrame([(1 << 62,), (-(1 << 62),)], "id long")),
        "clusters": ids.select((F.col("id") % 10 * (1 << 50) + F.col("id")).alias("id")),
        "equal": ids.select(F.lit(7).cast("long").alias("id")),
        "negative": ids.select((-F.col("id") * 3).alias("id")),
    }
    for name, table in tables.items():
        block = lines.order_blocks(table, "id", block_rows=500)
        placed = table.withColumn("block", block)
        sizes = placed.groupBy("block").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).orderBy("block").collect()
        assert all(a["high"] < b["low"] for a, b in zip(sizes, sizes[1:])), name
        if name != "equal":
            assert max(r["n"] for r in sizes) <= 2500, name
        if name == "outlier":
            numbered = lines.dense_index(table, "id", block_rows=500)
            assert numbered.where("row_id <> id").select("id", "row_id").collect() == [(1 << 60, 100_000)]
    some = spark.createDataFrame([(None,), (3,), (1,)], "id long")
    assert sorted(lines.dense_index(some, "id").collect()) == [(1, 0), (3, 1)]
    # No window sees all blocks: each has a key but for the one over the shares.
    plan = lines.dense_index(tables["clusters"], "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 3


def test_answer_object_is_one_object(spark, folder):
    import glob
    import json

    from textmill.sources import answers

    rows = [(f"q{k}", f'text "{k}",\n}} {{ é 가 \\') for k in range(50)] + [("none", None), (None, "x"), ("", "")]
    df = spark.createDataFrame(rows, "id string, prediction_text string").repartition(7)
    expected = {k: v for k, v in rows if k is not None}
    for name, table, wanted in (("some", df, expected), ("none", df.limit(0), {})):
        path = f"{folder}/{name}"
        answers.write_answer_object(table, path)
        text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/*")))
        assert json.loads(text) == wanted
        assert dict(map(tuple, answers.read_answer_object(spark, path).collect())) == wanted
