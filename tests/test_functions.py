import random
import time
import re

import pytest
from pyspark.sql import functions as F

from textmill.functions import byte_ids, overlap, text as tx
from textmill.functions.hashing import hash_bucket, hash_unit

TEXTS = ["", "a", "가나다 abc", "émoji 😀 x", "� kept", "tab\tnew\nline", "﷐", "ends 　"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_strip_matches_python(spark):
    values = ["", "  a b ", "　x\x1c", "\t\n", "a\x85", "no"]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select(tx.strip(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == [v.strip() for v in values]


def test_collapse_spaces_matches_python(spark):
    values = [" a \x1f  b\n\nc ", "", "　", "x"]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select(
        tx.collapse_spaces(F.col("t")).alias("s"), tx.words(F.col("t")).alias("w")).collect()
    assert [r.s for r in rows] == [" ".join(v.split()) for v in values]
    assert [r.w for r in rows] == [v.split() for v in values]


def test_render(spark):
    assert one(spark, tx.render("a {{ x }}-{{x}} b", x=F.lit("$1"))) == "a $1-$1 b"
    assert one(spark, tx.render("{{ x }}", x=F.lit(None).cast("string"))) == ""


def split_reference(text):
    parts = re.split(r"(.+?[가-힣]{3}[.?!]+)( +|$)", text)
    return [p.strip() for p in parts if p != "" and len(p) > 1]


def test_split_sentences_matches_a_regex_split(spark):
    rng = random.Random(5)
    alphabet = "가나다x .!?\n"
    texts = ["첫줄\n안녕하세요. 그래요. 반갑습니다! 끝", "abc", "", "가나다. 라마바. x", "하하하\n하하하.\n"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", tx.split_sentences(F.col("t")).alias("s")).collect()
    assert {r.i: r.s for r in rows} == {i: split_reference(t) for i, t in enumerate(texts)}


def test_byte_round_trip(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(
        "t", byte_ids.byte_encode(F.col("t")).alias("ids"),
        byte_ids.encoded_length(F.col("t")).alias("n"),
        byte_ids.byte_decode(byte_ids.byte_encode(F.col("t"))).alias("back")).collect()
    for r in rows:
        assert r.ids == [b + 3 for b in r.t.encode()] + [1]
        assert r.n == len(r.ids)
        assert r.back == r.t.replace("﷐", "�")  # the one character that is not kept apart


def test_decode_drops_invalid_bytes_and_specials(spark):
    raw = [237, 179, 68, 258, 131, 242, 194, 192, 0, 2, 1, 262]
    kept = bytes(i - 3 for i in raw if 3 <= i < 259)
    ids = F.array(*[F.lit(i) for i in raw])
    assert one(spark, byte_ids.byte_decode(ids)) == kept.decode("utf-8", errors="ignore")
    assert one(spark, byte_ids.byte_decode(ids, skip_special=False)).endswith("<extra_id_3>")


def test_truncation_keeps_the_end_mark(spark):
    assert one(spark, byte_ids.byte_encode(F.lit("abcdef"), 4)) == [100, 101, 102, 1]
    assert one(spark, byte_ids.byte_encode(F.lit("ab"), 4)) == [100, 101, 1]


@pytest.mark.parametrize("text, ids", [
    ("a<extra_id_0>b<extra_id_124>", [100, 259, 101, 383, 1]),
    ("<extra_id_125>", [b + 3 for b in b"<extra_id_125>"] + [1]),
    ("\u0001<extra_id_7>\n", [4, 266, 13, 1]),
])
def test_sentinels(spark, text, ids):
    assert one(spark, byte_ids.byte_encode(F.lit(text), sentinels=True)) == ids


def test_draws_do_not_depend_on_partitioning(spark):
    keys = spark.range(2000)
    draw = keys.select("id", hash_bucket(F.col("id"), 10, 42).alias("b"), hash_unit(F.col("id"), 42).alias("u"))
    again = keys.repartition(13).select("id", hash_bucket(F.col("id"), 10, 42).alias("b"))
    assert {(r.id, r.b) for r in draw.collect()} == {(r.id, r.b) for r in again.collect()}
    assert draw.filter((F.col("u") < 0) | (F.col("u") >= 1)).count() == 0
    assert draw.filter("id = 7").first().b == 1409445407 % 10


def run_reference(a, b):
    return max((j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b), default=0)


def lcs_table(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table


def test_longest_common_run():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("ab가") for _ in range(rng.randint(0, 20))) for _ in range(2))
        assert overlap.longest_common_run(a, b) == run_reference(a, b)
        assert overlap.longest_runs(a, [b, a, None, ""]) == [run_reference(a, b), len(a), None, 0]


def test_longest_run_of_long_texts():
    text = "".join(random.Random(3).choice("abc") for _ in range(40_000))
    started = time.perf_counter()
    assert overlap.longest_runs(text[15_000:] + "|" + text[:15_000], [text, "a" * 40_000, text[::-1]])[0] == 25_000
    assert time.perf_counter() - started < 5  # all windows of one length would be 10^9 characters


def test_lcs():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 15))] for _ in range(2))
        table = lcs_table(a, b)
        assert overlap.lcs_length(a, b) == table[-1][-1]
        traced = overlap._lcs_positions(a, b)
        assert len(traced) == table[-1][-1]


def test_ngram_counts():
    from collections import Counter

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        counts = overlap.ngram_counts(overlap.code_points(a), overlap.code_points(b), 6)
        for n, (p, r, m) in enumerate(counts, 1):
            ca, cb = (Counter(s[i:i + n] for i in range(len(s) - n + 1)) for s in (a, b))
            assert (p, r, m) == (sum(ca.values()), sum(cb.values()), sum((ca & cb).values()))
        assert len(counts) == 6


def test_label_trie_finds_the_nearest_without_comparing_all():
    import time

    from textmill.functions.nearest import LabelTrie

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(5)
    many = "".join(chr(0xAC00 + i) for i in range(80)) + "\U0001F600x"
    for letters in ("ab0", many) * 10:
        names = list(dict.fromkeys("".join(rng.choices(letters, k=rng.randint(0, 8))) for _ in range(rng.randint(1, 150))))
        values = ["", "z" * 14] + ["".join(rng.choices(letters + "q", k=rng.randint(0, 11))) for _ in range(20)]
        bounds = [rng.choice([None, 1, 4]) for _ in values]
        found = zip(*LabelTrie(names).nearest(values, bounds))
        for value, bound, (far, place) in zip(values, bounds, found):
            best = min((distance(value, name), i) for i, name in enumerate(names))
            assert (far, place) == best if bound is None or best[0] <= bound else place == -1

    # Names without any label nearby: all tie, or only one has the value as its end. 60 million distances otherwise.
    names = [f"Customer#{i:09d}" for i in range(100000)]
    start = time.perf_counter()
    far, place = LabelTrie(names).nearest([n[::-1] for n in names[:300]] + [n[9:] for n in names[-300:]], [None] * 600)
    assert time.perf_counter() - start < 20
    assert set(far[300:]) == {9} and place[300:].tolist() == list(range(99700, 100000)) and max(far[:300]) <= 18


def test_longest_runs_of_long_texts():
    """Whole documents at a time, exactly, also where hashes of windows meet for different texts."""
    import time

    rng = random.Random(6)
    for letters in ("a", "ab", "가나다\U0001F600x") * 8:
        size = overlap.AUTOMATON_CHARS + rng.randint(1, 200)
        text, other = "".join(rng.choices(letters, k=size)), "".join(rng.choices(letters, k=rng.randint(0, 300)))
        other = other[:40] + text[rng.randint(0, 99):rng.randint(100, size)] + other[40:]
        automaton = overlap.SuffixAutomaton(text)
        assert overlap.longest_runs(text, [other, other[::-1]]) == [automaton.longest_run(other), automaton.longest_run(other[::-1])]
    # A Thue-Morse word and its complement: window hashes modulo a power of two are equal though the texts are not.
    word = "0"
    for _ in range(12):
        word += word.translate({48: 49, 49: 48})
    other = word.translate({48: 49, 49: 48})
    assert overlap.longest_runs(word, [other]) == [overlap.longest_common_run(word, other)]
    text = "".join(rng.choices("abcdefghij ", k=30_000))
    start = time.perf_counter()
    for _ in range(30):
        assert overlap.longest_runs(text[10_000:] + "|" + text[:10_000], [text]) == [20_000]
    assert time.perf_counter() - start < 1.5
