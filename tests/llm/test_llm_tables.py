"""Vectors, conversations and the pipeline."""

import collections
import sys

import numpy as np
import oracle
import pytest
from textmill.llm import chat, vectors

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import corpus_pipeline  # noqa: E402

SF_DIR = f"{oracle.TESTDATA}/sf0.001"


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(100 + k, (base[k % 5] + rng.normal(size=16) * 0.12).tolist()) for k in range(60)]
    rows += [(300, base[0].tolist()), (301, (base[0] * 3).tolist()), (302, (base[1] * -1).tolist())]
    odd = [(400, None), (401, []), (402, [0.0] * 16), (403, [1.0, None]), (404, [float("nan")] * 16), (405, [float("inf")] * 16), (406, [1.0] * 3), (407, [2.0] * 3)]
    frame = spark.createDataFrame([(*r, 0, "x", 5) for r in rows + odd + [(None, base[0].tolist())]], "vec_id long, embedding array<double>, label int, key string, id int")
    for tile in (8, 1000):
        found = {r["vec_id"]: r for r in vectors.near_vectors(frame, tile=tile).collect()}
        assert len(found) == len(rows) + len(odd) + 1
        ids, table = [i for i, _ in rows], np.array([v for _, v in rows])
        unit = table / np.linalg.norm(table, axis=1)[:, None]
        close = unit @ unit.T >= 0.95
        label = np.arange(len(ids))
        for _ in ids:
            label = np.where(close, label[None, :], len(ids)).min(axis=1)
        for k, i in enumerate(ids):
            assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (close[k].sum() - 1, ids[label[k]], label[k] == k)
        assert all(found[i]["n_links"] == 0 and found[i]["component_id"] == i and found[i]["kept"] for i in range(400, 406))
        assert found[407]["component_id"] == 406 and found[406]["n_links"] == 1
        assert found[None]["n_links"] == 0 and found[None]["component_id"] is None
    assert vectors.near_vectors(frame.limit(0)).collect() == []
    assert len(vectors.near_vectors(frame.where("vec_id = 400")).collect()) == 1


def test_bounds_drop_no_pair():
    rng = np.random.default_rng(2)
    units = vectors.unit_rows(np.repeat(rng.normal(size=(40, 24)), 5, axis=0) + rng.normal(size=(200, 24)) * 0.15)
    axes = np.linalg.eigh(np.cov(units.T))[1][:, ::-1]
    tile = vectors.Tile(np.arange(200), np.ones(200, np.int64), units, np.full(200, 24), axes, [6, 12, 24])
    i, j = vectors.close_pairs(tile, slice(0, 200), tile, slice(0, 200), [6, 12, 24], 0.95)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(units @ units.T >= 0.95))))


TRICKY = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>assistant\n", "\\", "\\\\l", "\\l\\b\\n", "<|", "<\\|", "[INST", "", "  lines\n\nand é 🙂 ", "<<SYS>>x<</SYS>>", "a\\<|b"]


def test_formatting_reads_back(spark):
    rows = [(k, t, role, text, "x", 1) for k in range(3) for t, (role, text) in enumerate(
        [("system", TRICKY[k]), *(("user" if i % 2 else "assistant", x) for i, x in enumerate(TRICKY)), (None, None), ("odd\nrole <|end|>", "z")])]
    rows += [(9, None, "assistant", "first", "x", 1), (9, 1, "assistant", "b", "x", 1), (9, 1, "assistant", "a", "x", 1), (9, 1, "assistant", "a", "x", 1), (None, 0, "user", "u", "x", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, head string, id int")
    made = chat.format_turns(frame)
    from pyspark.sql import functions as F

    found = {r["conv_id"]: r for r in made.select("*", chat.read_turns(F.col("formatted")).alias("turns"),
                                                  chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert set(found) == {0, 1, 2, 9, None}
    for k in range(3):
        expected = [(role or "", text or "") for c, _, role, text, _, _ in rows if c == k]
        assert [tuple(t) for t in found[k]["turns"]] == expected
        assert found[k]["loss"] == "".join(text for role, text in expected if role == "assistant")
        assert found[k]["n_turns"] == len(expected) == found[k]["formatted"].count(chat.TURN_START)
        assert not any(c in found[k]["formatted"] for c in ("</s>", "[INST]", "<<SYS>>"))
    assert [t["text"] for t in found[9]["turns"]] == ["first", "a", "a", "b"]
    assert chat.format_turns(frame.limit(0)).collect() == []


def test_layouts_are_found_by_their_paths(spark):
    wanted = [("user", "hello"), ("assistant", "hi")]
    tables = [
        spark.createDataFrame([(1, [{"role": "user", "content": "hello"}, {"role": "assistant", "content": "hi"}], "x")],
                              "id long, messages array<struct<role: string, content: string>>, prompt string"),
        spark.createDataFrame([(1, [("human", "hello", 3), ("gpt", "hi", 4)])], "id long, conversations array<struct<`from`: string, value: string, weight: int>>"),
        spark.createDataFrame([(1, "hello", "", "hi")], "id long, instruction string, input string, output string"),
        spark.createDataFrame([(1, "hello", "hi")], "id long, prompt string, completion string"),
        spark.createDataFrame([(1, None, "hello", "hi")], "id long, system string, prompt string, response string"),
        spark.createDataFrame([(1, "hello", "hi", 2)], "id long, question string, answer string, turn int"),
    ]
    for table in tables:
        found = chat.canonical_turns(table, "id").orderBy("turn").collect()
        assert [(r["role"], r["text"]) for r in found] == wanted
    both = chat.canonical_turns(spark.createDataFrame([(1, "a", "b", "c")], "id long, instruction string, input string, output string"), "id").first()
    assert both["text"] == "a\n\nb"
    assert chat.format_records(tables[0], "id").first()["n_turns"] == 2
    assert chat.canonical_turns(spark.createDataFrame([(1, None)], "id long, messages array<struct<role: string, content: string>>"), "id").count() == 0
    with pytest.raises(ValueError, match="no layout"):
        chat.find_layout(spark.createDataFrame([(1, "x")], "id long, words string").schema)
    assert len(chat.BY_FINGERPRINT) == len(chat.LAYOUTS)


def test_layouts_mixed_in_one_table(spark):
    talk = [{"role": "human", "content": "hello"}, {"role": "gpt", "content": "hi"}]
    kind = ("id long, messages array<struct<role: string, content: string>>, instruction string, input string, output string, "
            "turn int, role string, text string, note string")
    rows = [(1, talk, None, None, None, None, None, None, None), (2, None, "hello", None, "hi", None, None, None, None),
            (3, [], "hello", "", "hi", None, None, None, None), (4, None, None, None, None, 0, "user", "hello", None),
            (4, None, None, None, None, 1, "assistant", "hi", None), (5, talk, "", "", "", None, None, None, "kept"),
            (6, [], None, None, None, None, None, None, None), (7, None, "hello", "there", None, None, None, None, None),
            (8, [(None, None)], None, None, None, None, None, None, None), (9, None, None, None, None, 3, None, None, None),
            (9, None, None, None, None, None, None, None, None)]
    found = {}
    for r in chat.canonical_turns(spark.createDataFrame(rows, kind), "id").orderBy("id", "turn").collect():
        found.setdefault(r["id"], []).append((r["role"], r["text"]))
    both = [("user", "hello"), ("assistant", "hi")]
    assert found == {1: both, 2: both, 3: both, 4: both, 5: both, 7: [("user", "hello\n\nthere")], 8: [("", "")], 9: [("", ""), ("", "")]}
    lost = spark.createDataFrame([*rows, (10, [], None, None, None, None, None, None, "words")], kind)
    with pytest.raises(Exception, match="no layout for the record 10"):
        chat.canonical_turns(lost, "id").collect()
    assert chat.canonical_turns(lost, "id", ("note",)).select("id").distinct().count() == len(found)
    assert {r["id"]: r["n_turns"] for r in chat.format_records(lost, "id", ("note",)).collect()} == {k: len(t) for k, t in found.items()}


def test_chat_query_goes_through_the_layouts(spark, monkeypatch):
    from textmill.llm import queries

    rows = spark.createDataFrame([(1, 5, "human", "hi", 0), (1, None, None, None, 0), (None, 0, "bot", "", 0)], "id long, turn int, role string, text string, n int")
    assert chat.find_layout(rows.schema).turn == "turn"
    assert [tuple(r) for r in chat.canonical_turns(rows, "id").collect()] == [(1, 5, "human", "hi"), (1, None, "", ""), (None, 0, "bot", "")]
    met = []
    monkeypatch.setattr(chat, "fingerprint", lambda paths, real=chat.fingerprint: met.append(tuple(paths)) or real(paths))
    made = queries.op3_chat_format(spark, SF_DIR)
    assert ("turn", "role", "text") in met and made.where("conv_id = -7").count() == 1


def plain_lines(docs):
    import textmill.llm.line_dedup as own

    key = lambda line: own.line_key(line.encode(), 10)
    holders = collections.defaultdict(set)
    for d, text in docs.items():
        for line in text.split("\n"):
            if key(line):
                holders[key(line)].add(d)
    return {d: "\n".join(x for x in text.split("\n") if not key(x) or min(holders[key(x)]) == d) for d, text in docs.items()}


def plain_near(docs):
    sets = {}
    for d, text in docs.items():
        w = text.encode().lower().split()
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in docs}
    links = [(a, b) for a in docs for b in docs if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in docs:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {d for d in docs if label[d] == d}


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "near_dedup", "mix_sources", "byte_bpe"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    texts = lambda frame: {r["doc_id"]: r["text"] for r in frame.collect()}

    good = corpus_pipeline.classify_quality(spark, docs, SF_DIR).cache()
    assert good.columns == docs.columns
    kept = texts(good)
    assert all(d in kept for d, q in labels.items() if q == 1) and not any(d in kept for d, q in labels.items() if q == 0)

    lined = corpus_pipeline.dedup_lines(spark, good, SF_DIR).cache()
    assert lined.schema == docs.schema and texts(lined) == plain_lines(kept)
    assert all(r["n_chars"] == len(r["text"]) for r in lined.collect())

    near = corpus_pipeline.dedup_near(spark, lined, SF_DIR).cache()
    assert near.columns == docs.columns and set(texts(near)) == plain_near(texts(lined))

    mixed = corpus_pipeline.mix_sources(spark, near, SF_DIR).cache()
    assert mixed.columns == docs.columns
    times = collections.Counter(r["doc_id"] for r in mixed.collect())
    sizes = {r["doc_id"]: len(r["text"].split()) for r in near.collect()}
    assert max(times.values()) <= 2 and set(times) <= set(sizes)
    total = sum(sizes.values())
    assert sum(sizes[d] * n for d, n in times.items()) == pytest.approx(1.5 * total, rel=0.25)

    encoded = corpus_pipeline.encode(spark, mixed, SF_DIR)
    assert sum(times.values()) == encoded.count()
    assert all(len(r["ids"]) == r["n_tokens"] for r in encoded.collect())


def test_pipeline_run(spark):
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    # A document may have lost all its lines to others; the rest have tokens.
    assert found and all(len(r["ids"]) == r["n_tokens"] for r in found) and sum(r["n_tokens"] > 0 for r in found) >= 0.9 * len(found)
