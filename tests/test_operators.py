import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from textmill.functions import fixed_values as fv
from textmill.functions.text import numbered_sentences
from textmill.operators import dataset, formatting, labels, prediction, tokens
from textmill.operators.dialogue import carry_forward, dialogue_states
from textmill.session import cut_lineage, dealt


def ids(spark, n, parts=4):
    return spark.range(0, n, 1, parts).withColumnRenamed("id", "row_id")


def test_split_is_complete_disjoint_and_stable(spark):
    df = ids(spark, 5000)
    split = dataset.train_test_split(df, 0.1, 0.2)
    counts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert sum(counts.values()) == 5000
    assert 400 < counts["test"] < 600 and 750 < counts["validation"] < 1050
    again = dataset.train_test_split(df.repartition(9), 0.1, 0.2)
    assert set(map(tuple, split.collect())) == set(map(tuple, again.collect()))
    assert {r.split for r in dataset.train_test_split(df).collect()} == {"train"}


@pytest.mark.parametrize("total", [0, 1, 7, 1000, 1003])
def test_exact_shards_partition_the_rows(spark, total):
    df = ids(spark, total)
    shards = [dataset.shard_sample(df, 4, 3, i, exact=True).collect() for i in range(4)]
    sizes = [len(s) for s in shards]
    assert max(sizes) - min(sizes) <= 1
    assert sorted(r.row_id for s in shards for r in s) == list(range(total))


def test_hash_shards_partition_the_rows(spark):
    df = ids(spark, 1000)
    rows = [r.row_id for i in range(3) for r in dataset.shard_sample(df, 3, 5, i).collect()]
    assert sorted(rows) == list(range(1000))


def test_shuffle_is_a_permutation(spark):
    rows = [r.row_id for r in dataset.shuffle_rows(ids(spark, 300), 1).collect()]
    assert sorted(rows) == list(range(300)) and rows != sorted(rows)
    assert rows == [r.row_id for r in dataset.shuffle_rows(ids(spark, 300).repartition(7), 1).collect()]


def test_length_filter(spark):
    df = spark.createDataFrame([("가", "b", "train"), ("abcd", "b", "train"), ("abcdefgh", "b", "test")],
                               "text string, label string, split string")
    assert dataset.filter_by_length(df, 7, ["text", "label"]).count() == 2  # 4 + 2 bytes is below 7, 5 + 2 is not
    assert dataset.filter_by_length(df, 5, ["text", "label"], unit="chars").count() == 2
    assert dataset.filter_by_length(df, 2, ["text", "label"], truncate=True).count() == 3
    assert dataset.filter_by_length(df, 0, ["text"]).count() == 3


def test_rebalance_adds_half_of_each_side(spark):
    df = ids(spark, 2000).withColumn("plausible_answer", F.col("row_id") % 3 == 0)
    out = dataset.rebalance(df)
    assert out.select("row_id", "copy_no").distinct().count() == out.count()
    extra = out.filter("copy_no = 1")
    assert extra.count() == dataset.shard_sample(df, 2, fv.REBALANCE_SEED).count()
    assert extra.filter("plausible_answer").count() > 250 and extra.filter("NOT plausible_answer").count() > 550


def test_reduce_answers(spark):
    kind = "array<struct<text:string,start_idx:int>>"
    df = spark.createDataFrame([([("a", 1), ("b", 2)],), ([],)], f"answers {kind}")
    rows = dataset.reduce_answers(df).collect()
    assert rows[0].answers.text == "b" and rows[0].answers.start_idx == 2 and rows[1].answers is None


def test_dedup_with_a_hot_text(spark):
    texts = ["hot"] * 400 + [f"t{i % 50}" for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").repartition(8)
    kept = dataset.dedup_passages(df).collect()
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    assert {(r.row_id, r.text) for r in kept} == {(i, t) for t, i in first.items()}


def test_dedup_consecutive(spark):
    texts = ["a", "a", "b", "a", "a", "a", "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "line_no long, text string")
    assert sorted(r.line_no for r in dataset.dedup_consecutive(df).collect()) == [0, 2, 3, 6]
    for block in (1, 2, 3):
        assert sorted(r.line_no for r in dataset.dedup_consecutive(df, block_rows=block).collect()) == [0, 2, 3, 6]
    two = df.withColumn("file_path", F.when(F.col("line_no") < 1, "x").otherwise("y"))
    sparse = df.withColumn("line_no", F.col("line_no") * (1 << 40))
    for block in (1, 2, 1000):
        assert sorted(r.line_no >> 40 for r in dataset.dedup_consecutive(sparse, block_rows=block).collect()) == [0, 2, 3, 6]
    kept = dataset.dedup_consecutive(two, within="file_path").collect()
    assert sorted(r.line_no for r in kept) == [0, 1, 2, 3, 6]


def test_states_are_carried_across_blocks(spark):
    roles = ["sys", "user", "sys", "sys", "other", "user", "user", "sys"] * 40
    rows = [(c, t, role, f"{role}{c}-{t}") for c in range(3) for t, role in enumerate(roles[:100 * (c + 1)])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    expected, state, previous, chars = set(), None, None, 0
    for c, t, role, text in rows:
        if t == 0:
            state, previous, chars = None, None, 0
        if role == "sys":
            expected.add((c, t, text, state, previous, t, chars))
            previous = state if state is not None else previous
        elif role == "user":
            state = text
        chars += len(text)
    for block in (3, 16, 4096):
        assert set(map(tuple, dialogue_states(df, block_rows=block).collect())) == expected


def test_carry_forward_with_gaps(spark):
    df = spark.createDataFrame([(1, 5, None), (1, 90, 2), (1, 1000, None), (2, 7, 4)], "k long, o long, v long")
    out = carry_forward(df, "k", "o", {"last": F.col("v")}, {"n": F.lit(1)}, block_rows=10).collect()
    assert sorted((r.k, r.o, r["last"], r.n) for r in out) == [(1, 5, None, 0), (1, 90, None, 1), (1, 1000, 2, 2),
                                                               (2, 7, None, 0)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest_label(spark):
    names = ["함의", "중립", "모순", "함이"]
    preds = ["함의", "함", "중린", "모순순", "", "xx", "함아"]
    df = spark.createDataFrame([(p,) for p in preds], "p string")
    got = {r.p: r.c for r in labels.apply_correction(df, "p", names, "c").collect()}
    assert got == {p: min(names, key=lambda n: edit_distance(p, n)) for p in preds}
    table = {r.label: r.corrected for r in labels.correction_map(df, "p", names).collect()}
    assert set(table) == set(preds) - set(names)


def test_label_maps(spark):
    df = spark.createDataFrame([(0,), (1,), (5,)], "y int")
    with pytest.raises(Exception, match="no label entry"):
        labels.map_labels(df, "y", {0: "a", 1: "b"}).collect()
    flagged = labels.map_labels(df, "y", {0: "a", 1: "b"}, "t", unmapped="flag").orderBy("y").collect()
    assert [(r.t, r.t_unmapped) for r in flagged] == [("a", False), ("b", False), (None, True)]
    assert [r.y for r in labels.map_labels(df, "y", None).collect()] == [0, 1, 5]
    big = {i: f"n{i}" for i in range(200)}
    assert sorted(r.y for r in labels.map_labels(df, "y", big).collect()) == ["n0", "n1", "n5"]
    table = spark.createDataFrame([(0, "zero"), (1, "one")], "id int, name string")
    joined = labels.map_labels(df, "y", table, "t", unmapped="flag").orderBy("y").collect()
    assert [(r.y, r.t, r.t_unmapped) for r in joined] == [(0, "zero", False), (1, "one", False), (5, None, True)]
    nested = spark.createDataFrame([(["a", "b"],), (["a"],)], "l array<string>")
    assert {r.label: r.n for r in labels.count_labels(nested, "l").collect()} == {"a": 2, "b": 1}


def test_templates(spark):
    df = spark.createDataFrame([(1, "좋아", 0)], "row_id long, document string, label int")
    row = formatting.format_template(df, "document", "label", label_map={0: "긍정"}).first()
    assert row.input_text == fv.DEFAULT_INPUT.replace("{{ input }}", "좋아") and row.target_text == "(긍정/부정) => 긍정"
    assert formatting.format_template(df, "document", "label").first().target_text == 0


def test_corrupted_answers(spark):
    answers = ["7", "서울", "2002년", "a b", ""]
    df = ids(spark, 500).withColumn("a", F.get(F.array(*[F.lit(a) for a in answers]), (F.col("row_id") % 5).cast("int")))
    rows = df.select("a", formatting.corrupt_answer(F.col("a"), F.col("row_id"), 1).alias("c")).collect()
    for r in rows:
        assert len(r.c) == len(r.a)
        changed = [(x, y) for x, y in zip(r.a, r.c) if x != y]
        assert len(changed) <= 1
        for x, y in changed:
            assert y.isdigit() if x.isdigit() else 0xAC00 <= ord(y) < 0xD7AF
        if r.a == "7":
            assert r.c != "7"
    assert {r.c for r in rows if r.a == "7"} == set("012345689")


def test_deliberation_shares(spark):
    df = ids(spark, 20000).select(
        "row_id", F.lit("답").alias("a"), (F.col("row_id") % 2 == 0).alias("no"))
    target = formatting.deliberation_target(F.col("a"), F.col("no"), F.col("row_id"), 0)
    counts = collections.Counter((r.no, r.t.split("\n")[0] == "출력: 답", r.t.endswith(fv.CORRECT_MARK))
                                 for r in df.select("no", target.alias("t")).collect())
    assert 0.77 < counts[True, False, True] / 10000 < 0.81
    assert 0.75 < counts[False, True, True] / 10000 < 0.79
    again = df.repartition(5).select("row_id", target.alias("t"))
    assert set(map(tuple, again.collect())) == set(map(tuple, df.select("row_id", target.alias("t")).collect()))


def test_ner_formatting(spark):
    df = spark.createDataFrame([(0, "ㅋㅋㅋ <서울:LC>;;; 가")], "row_id long, tagged_sent string")
    row = formatting.format_ner(df).first()
    assert row.input_text == fv.NER_INPUT.replace("{{ sentence }}", "ㅋ 서울; 가") and row.target_text == "ㅋ <서울:LC>; 가"
    assert formatting.format_ner(df, only_tags=True).first().target_text == "<서울:LC>"


def test_numbered_sentences(spark):
    row = spark.range(1).select(numbered_sentences(F.lit("안녕하세요. 반갑습니다.")).alias("s")).first()
    assert row.s == ["0 // 안녕하세요.", "1 // 반갑습니다."]


def test_padding(spark):
    df = spark.createDataFrame([(i, "x" * (i % 5), "y") for i in range(20)],
                               "row_id long, input_text string, target_text string")
    rows = tokens.pad_batch(df, 4, multiple=8).collect()
    for r in rows:
        assert len(r.input_ids) == len(r.attention_mask) == 8 and len(r.labels) == 8
        assert sum(r.attention_mask) == r.row_id % 5 + 1
        assert r.input_ids[sum(r.attention_mask) - 1] == fv.EOS_ID


def test_alignment(spark):
    pred = ids(spark, 5).withColumn("p", F.lit("x"))
    gold = ids(spark, 6).withColumn("g", F.lit("y"))
    assert prediction.align(pred, gold).count() == 5
    assert prediction.align(pred, ids(spark, 5), strict=True).count() == 5
    with pytest.raises(Exception, match="without counterpart"):
        prediction.align(pred, gold, strict=True).collect()
    assert tuple(prediction.alignment_report(pred, gold).first()) == (5, 0, 1, 0)


def test_retag(spark):
    import random

    rng = random.Random(4)
    rows = [("신동빈 신 회장", "<신동빈:PS> <신:PS>"), ("없다", "<서울:LC>"), ("a", "broken"), ("가나 다가 가", "<가:LC> <가:LC>")]
    for _ in range(300):
        sentence = "".join(rng.choice("ab 비") for _ in range(12))
        words = [sentence[i:i + rng.randint(1, 2)].strip() for i in sorted(rng.sample(range(11), 2))]
        rows.append((sentence, " ".join(f"<{w}:PS>" for w in words if w)))
    df = spark.createDataFrame(rows, "s string, t string")
    got = df.select("s", "t", prediction.retag_sentence(F.col("s"), prediction.label_elements(F.col("t"))).alias("r"))
    for r in got.collect():
        assert r.r == plain_retag(r.s, r.t.strip().replace("> <", ">▁<").split("▁")), (r.s, r.t)


def test_batch_generation_keeps_rows(spark):
    def load():
        return lambda texts: [f" {t}\n{len(texts)}" for t in texts]

    df = ids(spark, 50).withColumn("input_text", F.concat(F.lit(" a\\nb"), F.col("row_id").cast("string")))
    rows = prediction.batch_generate(df, load, batch_size=8).collect()
    assert len(rows) == 50
    for r in rows:
        assert re.fullmatch(rf"ab{r.row_id}[1-8]", r.prediction)


def test_gold_answers(spark):
    kind = "array<struct<text:string,start_idx:int>>"
    df = spark.createDataFrame([(True, [("a", 1)]), (False, [("b", 2), ("c", 3)])], f"p boolean, a {kind}")
    rows = df.select(prediction.gold_answers(F.col("p"), F.col("a")).alias("g")).collect()
    assert [[tuple(x) for x in r.g] for r in rows] == [[("[알 수 없음]", -1)], [("b", 2), ("c", 3)]]


def test_session_helpers(spark):
    rows = spark.range(0, 100, 1, 1)
    assert dealt(rows).rdd.getNumPartitions() == 1
    spark.conf.set("spark.textmill.dealPartitions", "5")
    try:
        assert dealt(rows).rdd.getNumPartitions() == 5
    finally:
        spark.conf.unset("spark.textmill.dealPartitions")
    assert cut_lineage(ids(spark, 10)).count() == 10


@pytest.mark.parametrize("size", [10, 1000])
def test_label_maps_keep_their_types_at_any_size(spark, size):
    for value, kind in ((lambda i: i + 1, "int"), (lambda i: i + 2 ** 40, "bigint"), (lambda i: i + 0.5, "double"), (lambda i: f"n{i}", "string")):
        df = spark.range(size)
        out = labels.map_labels(df, "id", {i: value(i) for i in range(size)}, "v")
        assert dict(out.dtypes)["v"] == kind
        assert {r.id: r.v for r in out.collect()} == {i: value(i) for i in range(size)}


def test_strict_alignment_wants_every_key_once(spark):
    golds = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, gold string")
    good = spark.createDataFrame([(1, "x"), (2, "y")], "row_id long, prediction string")
    assert prediction.align(good, golds, strict=True).count() == 2
    for rows in ([(1, "x"), (1, "z"), (2, "y")], [(1, "x")], [(1, "x"), (2, "y"), (3, "z")]):
        with pytest.raises(Exception, match="repeated or without counterpart"):
            prediction.align(spark.createDataFrame(rows, "row_id long, prediction string"), golds, strict=True).collect()
    report = prediction.alignment_report(spark.createDataFrame([(1, "x"), (1, "z"), (3, "y")], "row_id long, prediction string"), golds).first()
    assert report.asDict() == {"n_both": 1, "n_repeated": 1, "n_only_predicted": 1, "n_only_gold": 1}


def test_null_inputs_stay_null(spark):
    def load():
        return lambda texts: [t.upper() for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "None")], "row_id long, input_text string")
    assert {r.row_id: r.prediction for r in prediction.batch_generate(df, load, batch_size=2).collect()} == {1: "A", 2: None, 3: "NONE"}


def plain_retag(sentence, elements):
    """The rule in plain Python, where a place of -1 indexes from the end."""
    cursor = 0
    for element in elements:
        if not re.fullmatch("<.+:..>", element):
            continue
        word, tag = element[1:-4], element[-3:-1]
        at = sentence.find(word, cursor)
        if sentence.count(word, cursor) > 1 and at > 0 and sentence[at - 1] not in fv.TAG_BOUNDARY_CHARACTERS:
            at = sentence.find(word, cursor + at)
            if sentence[at - 1] not in fv.TAG_BOUNDARY_CHARACTERS:
                at = sentence.find(word, cursor + at)
        if at != -1:
            sentence = sentence[:at] + f"<{word}:{tag}>" + sentence[at + len(word):]
            cursor = at + len(word) + 5
    return sentence


def test_retagging_searches_again(spark):
    import random

    rng = random.Random(8)
    rows = [("가 xa ya", ["<가:PS>", "<a:LC>"])]
    for _ in range(300):
        sentence = "".join(rng.choice("abxy .가") for _ in range(rng.randrange(2, 25)))
        rows.append((sentence, [f"<{rng.choice(['a', 'ab', 'b', 'x', '가', 'ya'])}:PS>" for _ in range(rng.randrange(1, 5))]))
    df = spark.createDataFrame(rows, "s string, e array<string>")
    found = df.select("s", "e", prediction.retag_sentence(F.col("s"), F.col("e")).alias("t")).collect()
    assert found[0].t == "<가:PS> x<a:LC> ya"
    for r in found:
        assert r.t == plain_retag(r.s, r.e), (r.s, r.e)


def test_nearest_label_of_a_table(spark):
    """10,000 labels, against every distance computed."""
    import duckdb

    rng = random.Random(4)
    names = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))) for _ in range(10000)]
    preds = [names[0], None, "", "zzzzzzzzzzzzzzzzzz", "q" * 60, "a'b"]
    for _ in range(150):
        word = list(rng.choice(names))
        for _ in range(rng.randint(1, 4)):
            word.insert(rng.randint(0, len(word)), rng.choice("abx"))
        preds.append("".join(word))
    preds += [preds[-1]] * 40
    df = spark.createDataFrame([(i, p) for i, p in enumerate(preds)], "i long, p string")
    table = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "label string, place long")
    got = {r.i: r.c for r in labels.apply_correction(df, "p", table, "c").collect()}
    base = duckdb.connect()
    base.execute("CREATE TABLE n (label VARCHAR, place BIGINT)")
    base.execute("CREATE TABLE p (p VARCHAR)")
    base.executemany("INSERT INTO p VALUES (?)", [(p,) for p in {p for p in preds if p is not None}])
    base.execute("INSERT INTO n SELECT unnest(?), unnest(range(10000))", [names])
    expected = dict(base.execute("SELECT p, arg_min(label, levenshtein(p, label) * 100000 + place) FROM p, n GROUP BY p").fetchall())
    assert got == {i: expected.get(p) for i, p in enumerate(preds)}
    table = {r.label: (r.corrected, r.n) for r in labels.correction_map(df, "p", table).collect()}
    wrong = {p for p in preds if p is not None} - set(names)
    assert {p: c for p, (c, _) in table.items() if p is not None} == {p: expected[p] for p in wrong}
    assert table[preds[-1]][1] == preds.count(preds[-1])


def test_batches_by_length(spark):
    rng = random.Random(3)
    sizes = [rng.choice([3, 70, 70, 130, 900]) for _ in range(300)] + [0, 5000]
    df = spark.createDataFrame([(f"k{i}", "x" * n, "y") for i, n in enumerate(sizes)] + [("null", None, "y")],
                               "row_id string, input_text string, target_text string")
    rows = tokens.pad_by_length(df, 2048).collect()
    assert len(rows) == len(sizes) + 1
    batches = {}
    for r in rows:
        batches.setdefault((r.bucket, r.batch_id), []).append(r)
    for (bucket, _), batch in batches.items():
        widths = {len(r.input_ids) for r in batch if r.input_ids is not None}
        assert len(widths) <= 1 and all(w <= bucket for w in widths)
        assert len(batch) * bucket <= 2048 or len(batch) == 1
    full = {}
    for (bucket, _), batch in batches.items():
        full.setdefault(bucket, []).append(len(batch) == max(1, 2048 // bucket))
    assert all(done.count(False) <= 2 for done in full.values())
    assert {r.row_id: r.batch_id for r in rows} == {r.row_id: r.batch_id for r in tokens.pad_by_length(df.repartition(7), 2048).collect()}


def test_length_quantiles_are_exact(spark):
    """More lengths than a sketch of 10,000 tells apart, and rows without text."""
    rows = spark.range(400000).selectExpr("id % 2 as g", "if(id % 10 = 7, null, repeat('a', cast(id % 30011 as int))) as t")
    got = {r.g: r for r in tokens.length_profile(rows, "t", ["g"], (0.0, 0.5, 0.55, 0.99, 1.0)).collect()}
    for group in (0, 1):
        lengths = sorted(i % 30011 + 1 for i in range(group, 400000, 2) if i % 10 != 7)
        places = [max(1, -(-len(lengths) * percent // 100)) - 1 for percent in (0, 50, 55, 99, 100)]
        assert got[group].quantiles == [lengths[i] for i in places]
        assert (got[group].n_rows, got[group].max_length, got[group].sum_length) == (200000, lengths[-1], sum(lengths))
    empty = tokens.length_profile(rows.limit(0), "t").first()
    assert (empty.n_rows, empty.max_length, empty.quantiles) == (0, None, [None] * 3)
