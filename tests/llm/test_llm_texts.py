"""Text operators on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from textmill.llm import bpe, components, line_dedup, minhash, mixing, passages, quality, rules, scoring
from textmill.llm.common import shingle_hashes, word_list

SCHEMA = "doc_id long, text string, source string, id long, part int, key string, n_lines string, kept string"


def frame(spark, rows):
    """Documents with columns that clash with names the operators use."""
    return spark.createDataFrame([(d, t, s, -1, 3, "k", "n", "x") for d, t, s in rows], SCHEMA)


def words(n, seed=0):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]


ODD = [(1, None, "a"), (2, "", None), (None, "a null id has no part in anything but its own row", "a"), (3, " \n\t ", "b"), (4, "x", "b")]


def closure(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_near_duplicates(spark):
    base = words(200)
    texts = {10: base, 11: base, 12: base[:-3] + ["other", "end", "here"], 13: [*base[:40], "X", *base[41:]], 20: words(200, 1), 21: words(4, 2), 22: words(4, 2)}
    # A chain: neighbours are alike, its ends are not.
    for k in range(12):
        texts[100 + k] = words(150 + 12 * k, 7)[12 * k:]
    # Loose copies of one text: some reach the similarity, some don't.
    rng = random.Random(3)
    for k in range(40):
        copy = list(base)
        for _ in range(rng.randrange(12)):
            copy[rng.randrange(len(copy))] = f"e{rng.random()}"
        texts[200 + k] = copy
    rows = [*ODD, *((d, " ".join(w).upper() if d == 11 else " ".join(w), "s") for d, w in texts.items())]
    rows += [(10, " ".join(base), "s")]
    result = minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(result) == len(rows)
    sets = {d: set(shingle_hashes(word_list(" ".join(w).encode())).tolist()) for d, w in texts.items()}
    sets |= {d: set(shingle_hashes(word_list((t or "").encode())).tolist()) for d, t, _ in ODD if d is not None}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = closure(sets, linked)
    for r in result:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(frame(spark, [])).collect() == []
    assert {r["component_id"] for r in minhash.near_duplicates(frame(spark, ODD)).collect()} == {1, 2, 3, 4, None}


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2500]
    signature = minhash.super_minhash([np.unique(a), np.unique(b), np.empty(0, np.uint64), pool[:1]], 200)
    assert abs((signature[0] == signature[1]).mean() - 0.6) < 0.12
    assert (signature[2] == minhash.UNSET).all() and len(np.unique(signature[3] >> np.uint64(32))) == 200
    # The slow definition: every element walks its whole permutation.
    slots, expected = 16, np.full(16, minhash.UNSET)
    small = pool[:5]
    for x in small:
        order = list(range(slots))
        for level in range(slots):
            drawn = int(minhash._draw(np.array([x]), level)[0])
            swap = level + ((drawn >> 32) * (slots - level) >> 32)
            order[level], order[swap] = order[swap], order[level]
            expected[order[level]] = min(int(expected[order[level]]), level << 32 | drawn & 0xFFFFFFFF)
    assert (minhash.super_minhash([small], slots)[0] == expected).all()


def test_super_minhash_holds_few_permutations():
    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(600)]
    tracemalloc.start()
    try:
        minhash.super_minhash(sets, 200)
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)]
    label = closure({x for p in links for x in p}, links)
    found = {r["vertex"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert found == {v: c for v, c in label.items() if v != c}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_few_links_need_no_shuffle(spark, monkeypatch):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)]
    label = closure({x for p in links for x in p}, links)
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    rounds = []
    whole = components._step
    monkeypatch.setattr(components, "_step", lambda edges: rounds.append(1) or whole(edges))
    monkeypatch.setattr(components, "_stars", lambda edges, stars=components._stars: rounds.append(1) or stars(edges))
    assert {r["vertex"]: r["component"] for r in components.components(df).collect()} == {v: c for v, c in label.items() if v != c}
    assert not rounds
    # More links than a task takes are put together in rounds.
    monkeypatch.setattr(components, "FOLD", 40)
    assert {r["vertex"]: r["component"] for r in components.components(df).collect()} == {v: c for v, c in label.items() if v != c}
    assert rounds


def test_line_dedup(spark):
    rows = [*ODD, (5, "a repeated line here\nown first line\n A REPEATED line here\t\nshort", "s"), (6, "a repeated line here\nshort\nés repeated line É\n", "s"),
            (7, "és repeated line É\nÉs repeated line É\n" + "\n" * 5000, "s"), (8, "own line twice\nown line twice", "s")]
    docs = frame(spark, rows)
    result = line_dedup.dedup_lines(docs)
    assert set(result.columns) == {*docs.columns, "n_dropped"}
    found = {r["doc_id"]: r for r in result.collect()}
    assert len(found) == len(rows)
    assert found[5]["text"] == rows[5][1] and found[5]["n_dropped"] == 0
    assert (found[6]["text"], found[6]["n_lines"], found[6]["n_dropped"]) == ("short\nés repeated line É\n", 4, 1)
    assert found[7]["text"] == "És repeated line É\n" + "\n" * 5000 and found[7]["n_lines"] == 5003
    assert found[8]["n_dropped"] == 0 and found[1]["n_lines"] == 1 and found[1]["text"] == "" and found[None]["n_dropped"] == 0
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    three = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs, min_docs=3).collect()}
    assert set(three.values()) == {0}


def plain_targets(sizes, weights, percent, epochs):
    """Round by round: what is above its cap is clamped, the excess shared anew."""
    from fractions import Fraction

    total, targets, free = Fraction(sum(sizes) * percent, 100), {}, set(range(len(sizes)))
    while free:
        share = (total - sum(targets.values())) / sum(weights[i] for i in free)
        above = [i for i in free if share * weights[i] >= epochs * sizes[i]]
        if not above:
            return {**targets, **{i: share * weights[i] for i in free}}
        for i in above:
            targets[i] = Fraction(epochs * sizes[i])
            free.remove(i)
    return targets


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "a", "a", "a", "b", "c", "É", None])) for k in range(400)]
    rows += [(400, None, "z"), (None, "two words", "a"), (7, rows[7][1], rows[7][2])]
    found = mixing.mix(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(frame(spark, rows).repartition(5)).collect()))
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == name) for name in names]
    targets = plain_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 150, 2)
    taken, longest = collections.Counter(), collections.Counter()
    for r in found:
        i = names.index(r["source"])
        assert r["source_size"] == sizes[i] and r["target"] == pytest.approx(float(targets[i])) and r["taken"] == r["size"] * r["repeats"] <= 2 * r["size"]
        taken[i] += r["taken"]
        longest[i] = max(longest[i], r["size"])
    assert all(abs(taken[i] - float(targets[i])) <= longest[i] for i in range(len(names)))
    assert mixing.mix(frame(spark, [])).collect() == []
    assert [r["taken"] for r in mixing.mix(frame(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.binary(min_size=0, max_size=12)), min_size=1, max_size=5), st.integers(0, 9))
def test_removable_pieces(parts, seed):
    rng = np.random.default_rng(seed)
    gram = b"0123456789abcdef"
    pieces, sizes, offsets, ids = [], [], [], []
    for k, (lead, tail) in enumerate(parts * 3):
        body = bytes(rng.integers(97, 99, lead).astype(np.uint8)) + gram + tail
        if len(body) >= 20:
            pieces.append(body.ljust(40, b"\0")[:40])
            sizes.append(min(len(body), 24))
            offsets.append(lead)
            ids.append(int(rng.integers(0, 5)))
    if not pieces:
        return
    table = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, 40)[:, :24].copy()
    table[np.arange(24)[None, :] >= np.array(sizes)[:, None]] = 0
    found = passages.removable(table, np.array(sizes), np.ones(len(pieces), np.uint64), np.array(offsets), np.array(ids), 20)
    first = {}
    for p, s, o, i in zip(pieces, sizes, offsets, ids):
        for t in range(s - 19):
            first[o - t, p[t:t + 20]] = min(first.get((o - t, p[t:t + 20]), i), i)
    for row, (p, s, o, i) in enumerate(zip(pieces, sizes, offsets, ids)):
        assert found[row].tolist() == [t < s - 19 and first[o - t, p[t:t + 20]] < i for t in range(5)]


def test_collisions_are_verified(monkeypatch):
    """With a hash that tells nothing apart, order and equality come from the bytes."""
    monkeypatch.setattr(passages.PrefixHash, "__call__", lambda self, start, length: np.zeros(len(start), np.uint64))
    data = np.frombuffer(b"bbbbaaaabbbbcccc", np.uint8)
    order, equal = passages.suffix_order(data, np.array([0, 4, 8, 12]), np.zeros(4, np.int64), 4)
    assert sorted(map(tuple, [(data[4 * i:4 * i + 4].tobytes(), bool(e)) for i, e in zip(order, equal)])) == [
        (b"aaaa", False), (b"bbbb", False), (b"bbbb", True), (b"cccc", False)]


def test_passages(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [*ODD, (5, long, "s"), (6, "x" * 30 + long[100:160] + "é" * 40, "s"), (7, long, "s"), (8, "y" + long[120:155] + "z" + long[:49], "s"),
            (9, "a" * 300, "s"), (10, "b" + "a" * 120 + "b", "s"), (11, "ab" * 60 + long, "s"), (4, "x", "b"), (12, "ab" * 3000, "s")]
    found = passages.dedup_passages(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    texts = sorted({(d, (t or "").encode()) for d, t, _ in rows if d is not None})
    first = {}
    for d, t in texts:
        for i in range(len(t) - 49):
            first.setdefault(t[i:i + 50], d)
    expected = {None: (len(ODD[2][1]), 0, 0, ODD[2][1].encode())}
    for d, t in texts:
        marks = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i:i + 50]] < d:
                marks[i:i + 50] = b"\1" * 50
        runs = len(re.findall(b"\1+", bytes(marks)))
        expected[d] = (len(t), sum(marks), runs, bytes(c for c, m in zip(t, marks) if not m))
    for r in found:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == expected[r["doc_id"]], r["doc_id"]
        assert sum(s["to"] - s["from"] for s in r["spans"]) == r["n_removed"]
    assert expected[6][1] == 60 and expected[7][1] == 400
    assert passages.dedup_passages(frame(spark, [])).collect() == []


def test_template_lines_spread(spark):
    """Differing pieces around one anchor go on as single strings, to many groups, with the same result."""
    rng = random.Random(6)
    line = "This is the notice of terms that all pages show, "
    rows = [(k, f"{rng.random()} {line}{rng.randrange(40)} on {rng.randrange(9)}. " + line[:k % 49] + f"{k % 5}" * 3, "s") for k in range(400)]
    texts = frame(spark, rows).selectExpr("doc_id AS id", "cast(text AS binary) AS text")
    total = sum(len(t) for _, t, _ in rows)
    hot = passages.hot_anchors(texts, total, 50, 100)
    keys = np.concatenate([x[4] for x in passages.text_anchors([t.encode() for _, t, _ in rows], 50)])
    found, n = np.unique(keys, return_counts=True)
    assert (n >= 100).any() and set(found[n >= 100]) <= set(hot) <= set(found[n >= 50])
    first, expected = {}, {}
    for d, t, _ in rows:
        marks = bytearray(len(t))
        for i in range(len(t) - 49):
            if first.setdefault(t[i:i + 50], d) < d:
                marks[i:i + 50] = b"\1" * 50
        expected[d] = (sum(marks), "".join(c for c, m in zip(t, marks) if not m).encode())
    assert sum(x for x, _ in expected.values()) > 1000
    for most in (1, 100, 1 << 16):
        made = passages.dedup_passages(frame(spark, rows), most=most).collect()
        assert {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in made} == expected


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.transducer.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="aethin .\n'sréß中🙂1\x1c\x85", max_size=120)))
def test_encoding_round_trip(codec, library, text):
    ids = codec.encode(text)
    assert list(ids) == library.encode_ordinary(text)
    assert codec.decoder.raw(ids) == (text.encode(), True)
    assert "".join(codec.decoder.stream(ids)) == text


def test_long_pieces_and_few_states(codec, library):
    small = bpe.Transducer(codec.transducer.ranks, max_states=50)
    for text in ("a" * 30_000, "thinking" * 3000, "é" * 9000, "=" * 10_000 + "?!" * 3000, " " * 20_000):
        assert list(codec.encode(text)) == library.encode_ordinary(text)
        assert small.encode(text.encode()) == codec.transducer.encode(text.encode())


def test_states_are_kept_small(codec):
    own = bpe.Transducer(codec.transducer.ranks)
    rng = random.Random(4)
    pieces = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(12)).encode() for _ in range(3000)]
    tracemalloc.start()
    try:
        for piece in pieces:
            own.encode(piece)
        assert tracemalloc.get_traced_memory()[0] < 500 * len(own.states)
    finally:
        tracemalloc.stop()


def test_decoding_broken_bytes(codec):
    names = codec.transducer.names
    byte = {v: k for k, v in names.items() if len(v) == 1}
    ids = [byte[bytes([b])] for b in b"a\xff\xc3\xa9\xe4\xb8"]
    data, whole = codec.decoder.raw(ids)
    assert data == b"a\xff\xc3\xa9\xe4\xb8" and not whole
    assert "".join(codec.decoder.stream(ids)).startswith("a�")


def test_encode_texts(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = {r["doc_id"]: r for r in bpe.encode_texts(frame(spark, ODD), path, public_tokenizers.PATTERN).collect()}
    assert len(found) == len(ODD) and found[1]["n_tokens"] == found[2]["n_tokens"] == 0 and found[1]["ids"] == []
    assert found[4]["decoded_sha256"] == hashlib.sha256(b"x").hexdigest() and found[None]["whole"]
    assert bpe.encode_texts(frame(spark, []), path, public_tokenizers.PATTERN).collect() == []


def test_quality_classifier_edges(spark):
    docs = frame(spark, [*ODD, *((100 + k, "good plain words in a row " * (k + 1), "s") for k in range(12)),
                         *((200 + k, "BAD!!! $$$ ### " * (k + 2), "s") for k in range(12))])
    labels = spark.createDataFrame([*((100 + k, 1) for k in range(12)), *((200 + k, 0) for k in range(12)), (100, 1), (None, 1), (1, None), (999, 0)],
                                   "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(found) == 29
    assert all(found[100 + k]["predicted"] == 1 and found[200 + k]["predicted"] == 0 for k in range(12))
    assert all(0 <= r["score"] <= 1 for r in found.values())
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    one = {r["score"] for r in quality.classify(docs, labels.where("quality = 1")).collect()}
    assert len(one) == 1 and one.pop() > 0.9
    assert quality.classify(frame(spark, []), labels).collect() == []


def test_rules_edges(spark):
    docs = frame(spark, [*ODD, *((100 + k, " ".join(words(30 + k, k)), "s") for k in range(30)), *((200 + k, " ".join(f"{w} ###" for w in words(30, k)), "s") for k in range(30)),
                         (300, " ".join(words(8, 1) * 5), "s"), (301, " ".join(words(100, 3) + words(8, 4) * 2), "s")])
    labels = spark.createDataFrame([*((100 + k, 1) for k in range(30)), *((200 + k, 0) for k in range(30)), (None, 0), (1, None)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in rules.judge(docs, labels).collect()}
    assert len(found) == len(ODD) + 62
    assert all(found[100 + k]["kept"] and not found[200 + k]["kept"] and not found[200 + k]["base_failed"] for k in range(30))
    assert found[300]["n_repeat_words"] == 40 and found[300]["base_failed"] and found[301]["n_repeat_words"] == 16 and not found[301]["base_failed"]
    assert found[1]["n_words"] == 0 and found[1]["base_failed"]
    learned = rules.learn(rules.statistics(docs), labels)
    assert learned and all(r.good == 0 for r in learned)
    assert rules.learn(rules.statistics(docs), labels.limit(0)) == []
    assert rules.judge(frame(spark, []), labels).collect() == []


def test_context_tree_is_a_distribution_and_learns():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on", "mats"]) for _ in range(60)).encode() for _ in range(60)]
    lengths, codes, _ = scoring.common_contexts(texts, 4000)
    nodes = scoring.ContextNodes.of(lengths, codes)
    seen = np.concatenate([nodes.longest(data, places) << 8 | data[places] for data, places, _, _ in scoring.joined(texts)])
    keys, counts = np.unique(seen, return_counts=True)
    tree = scoring.weigh(nodes, keys, counts, 4000)
    rows = 10.0 ** tree.rows.reshape(-1, 256)[1:].astype(float)
    assert np.allclose(rows.sum(axis=1), 1, atol=1e-4)
    own, other = tree.scores([texts[0], bytes(reversed(texts[0])), b""])[:2]
    assert own > other and tree.scores([b""])[0] < 0
    # With the empty context only, it is the mean estimate of each node of the decomposition.
    flat = scoring.weigh(scoring.ContextNodes.of(np.empty(0, int), np.empty(0, int)), np.array([256 + 65, 256 + 66]), np.array([3, 1]))
    assert 10 ** float(flat.rows[256 + 65]) == pytest.approx(_plain_estimate({65: 3, 66: 1}, 65), rel=1e-4)


def _plain_estimate(counts, symbol):
    out = 1.0
    for bit in range(7, -1, -1):
        ones = sum(n for s, n in counts.items() if s >> (bit + 1) == symbol >> (bit + 1) and s >> bit & 1)
        zeros = sum(n for s, n in counts.items() if s >> (bit + 1) == symbol >> (bit + 1) and not s >> bit & 1)
        out *= ((ones if symbol >> bit & 1 else zeros) + 0.5) / (zeros + ones + 1)
    return out


def test_repeated_rows_are_all_scored(spark):
    rows = scoring.score_texts(frame(spark, [(5, "the same words", "s")] * 3 + [(6, "other", "s"), (None, "", "s"), (None, "", "s")]), F.lit(True)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["5", "5", "5", "6", "None", "None"]
    assert len({tuple(r) for r in rows}) == 3 and all(r["n_known"] == 4 for r in rows if r["doc_id"] == 5)


def test_every_context_counts(spark):
    """Scores are those of the dense tree of all contexts that are met, however rarely."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["the", "cat", "sät", "on", "mats", f"w{k % 7}"]) for _ in range(100)) + " rare" * (k == 1), "s") for k in range(300)]
    texts = [t.encode() for _, t, _ in rows]
    train = [t for (k, _, _), t in zip(rows, texts) if k % 3]
    nodes = scoring.ContextNodes.of(*scoring.common_contexts(train, 1 << 40)[:2])
    keys, counts = np.unique(np.concatenate([nodes.longest(data, places) << 8 | data[places] for data, places, _, _ in scoring.joined(train)]),
                             return_counts=True)
    expected = scoring.weigh(nodes, keys, counts, 1 << 40).scores(texts)
    found = {r["doc_id"]: r["score"] for r in scoring.score_texts(frame(spark, rows), F.col("doc_id") % 3 != 0).collect()}
    assert [found[k] for k, _, _ in rows] == pytest.approx(expected.tolist(), rel=1e-4)


def test_scores_edges(spark):
    docs = frame(spark, [*ODD, (5, "the same words", "s"), (5, "the same words", "s"), (6, "z" * 50_000, "s")])
    found = {r["doc_id"]: r for r in scoring.score_texts(docs, F.col("doc_id") > 2).collect()}
    assert len(found) == 7 and found[1]["n_tokens"] == 1 and found[5]["n_tokens"] == 4 and found[5]["n_known"] == 4
    assert found[1]["train_tokens"] == 1 + 2 + 8 + 2
    untrained = {r["doc_id"]: r for r in scoring.score_texts(docs, F.lit(False)).collect()}
    assert untrained[4]["score"] == pytest.approx(2 * np.log10(1 / 256), rel=1e-4) and untrained[4]["base_score"] == 0 and untrained[4]["n_known"] == 0
    assert scoring.score_texts(frame(spark, []), F.lit(True)).collect() == []


def test_suffix_order_of_a_large_group_reads_words():
    import time

    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, 120_000).astype(np.uint8) * 255
    items, group = np.arange(len(data) - 50), np.repeat([4, 9], [50_000, len(data) - 50 - 50_000])
    start = time.process_time()
    order, equal = passages.suffix_order(data, items, group, 50)
    assert time.process_time() - start < 1
    strings = [(int(g), data[i:i + 50].tobytes()) for g, i in zip(group, items)]
    assert order.tolist() == sorted(range(len(items)), key=strings.__getitem__)
    assert equal.tolist() == [False, *(strings[a] == strings[b] for a, b in zip(order[1:], order[:-1]))]
