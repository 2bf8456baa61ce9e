"""The registered queries of the pipeline operators: against their SQL, or against plain Python where there is none."""

import base64
import collections
import hashlib
import math
import re
import zlib

import oracle
import public_tokenizers
import pytest
import tiktoken
from textmill.llm.queries import QUERIES

SF_DIR = f"{oracle.TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF_DIR)


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_same_as_sql(spark, connection, name):
    columns, rows = oracle.spark_rows(QUERIES[name].run(spark, SF_DIR))
    expected_columns, expected = oracle.sql_rows(connection, QUERIES[name].sql)
    assert columns == expected_columns
    assert rows == expected


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_quality_classifier_separates_held_out_rows(spark, documents, labels):
    rows = {r["doc_id"]: r for r in QUERIES["op2_quality_classifier"].run(spark, SF_DIR).collect()}
    assert set(rows) == set(documents)
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    held = [d for d in labels if rows[d]["held_out"]]
    assert sum(rows[d]["predicted"] == labels[d] for d in held) >= 0.9 * len(held)


def test_byte_bpe_is_what_the_library_gives(spark, documents):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for row in QUERIES["op8_byte_bpe"].run(spark, SF_DIR).collect():
        text = documents[row["doc_id"]]
        ids = library.encode_ordinary(text)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def plain_statistics(text):
    space = " \t\n\r\x0b\x0c"
    words = [w for w in re.split(f"[{space}]+", text) if w]
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.strip(space)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, documents, labels):
    rows = {r["doc_id"]: r for r in QUERIES["op9_quality_rules"].run(spark, SF_DIR).collect()}
    assert set(rows) == set(documents)
    for d, r in rows.items():
        found = plain_statistics(documents[d])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == found
        assert r["base_failed"] == (found[0] < 20 or 100 * found[4] > 30 * found[0])
        assert not (r["base_failed"] and r["kept"])
    good = [d for d in labels if labels[d] == 1 and not rows[d]["base_failed"]]
    assert sum(rows[d]["kept"] for d in good) >= 0.95 * len(good)


def test_language_model_scores(spark, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op10_lm_score"].run(spark, SF_DIR).collect()}
    assert set(rows) == set(documents)
    tokens = {d: t.encode().lower().split() + [b""] for d, t in documents.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in documents}
    counts = collections.Counter(w for d in documents if not held[d] for w in tokens[d])
    total, distinct = sum(counts.values()), len(counts)
    for d, r in rows.items():
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens[d])
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            held[d], len(tokens[d]), sum(counts[w] > 0 for w in tokens[d]), total)
        assert r["score"] < 0 and r["bits_per_byte"] > 0
    own = [r for r in rows.values() if r["held_out"]]
    assert sum(r["bits_per_byte"] for r in own) / len(own) < 4
