import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textmill.functions import fixed_values as fv
from textmill.functions.text import normalize_question_answer, normalize_reading_answer
from textmill.operators.metrics import answers, classification, dependency, overlap, states, tagging


def pairs(spark, rows):
    return spark.createDataFrame(rows, "pred string, gold string")


def random_texts(seed, n, alphabet="ab 가.\n"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def chrf_reference(rows, char_order, word_order, beta):
    def words(text):
        out = []
        for w in text.split():
            if len(w) > 1 and w[-1] in string.punctuation:
                out += [w[:-1], w[-1]]
            elif len(w) > 1 and w[0] in string.punctuation:
                out += [w[0], w[1:]]
            else:
                out.append(w)
        return out

    totals = []
    for kind, order in (("c", char_order), ("w", word_order)):
        for n in range(1, order + 1):
            p = g = m = 0
            for pred, gold in rows:
                sides = [("".join(t.split()) if kind == "c" else words(t)) for t in (pred, gold)]
                a, b = (Counter(tuple(s[i:i + n]) for i in range(len(s) - n + 1)) for s in sides)
                p += sum(a.values()) if b else 0
                g += sum(b.values())
                m += sum((a & b).values())
            totals.append((p, g, m))
    used = [(m / p, m / g) for p, g, m in totals if p and g]
    if not used:
        return 0.0
    precision, recall = (sum(x[i] for x in used) / len(used) for i in (0, 1))
    if precision + recall == 0:
        return 0.0
    return 100 * (1 + beta ** 2) * precision * recall / (beta ** 2 * precision + recall)


@pytest.mark.parametrize("char_order, word_order, beta", [(6, 0, 2.0), (0, 1, 1.0), (6, 2, 2.0), (6, 0, 1.0)])
def test_chrf(spark, char_order, word_order, beta):
    rows = list(zip(random_texts(1, 60), random_texts(2, 60)))
    got = overlap.chrf(pairs(spark, rows), char_order=char_order, word_order=word_order, beta=beta).first().chrf
    assert got == pytest.approx(chrf_reference(rows, char_order, word_order, beta))
    same = [(g, g) for _, g in rows if g.strip()]
    assert overlap.chrf(pairs(spark, same), char_order=char_order, word_order=word_order, beta=beta
                        ).first().chrf == pytest.approx(100)


def test_chrf_without_text(spark):
    assert overlap.chrf(pairs(spark, [("", ""), ("a", "")])).first().chrf == 0.0


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table


def union_hits(gold, pred):
    left_g, left_p = Counter(sum(gold, [])), Counter(sum(pred, []))
    hits = 0
    for g in gold:
        marked = set()
        for p in pred:
            table, i, j = lcs(g, p), len(g), len(p)
            while i and j:
                if g[i - 1] == p[j - 1]:
                    marked.add(i - 1)
                    i, j = i - 1, j - 1
                elif table[i][j - 1] > table[i - 1][j]:
                    j -= 1
                else:
                    i -= 1
        for k in sorted(marked):
            if left_g[g[k]] > 0 and left_p[g[k]] > 0:
                left_g[g[k]] -= 1
                left_p[g[k]] -= 1
                hits += 1
    return hits


def rouge_reference(pred, gold):
    def tokens(t):
        return re.sub("[^a-z0-9]+", " ", t.lower()).split()

    def f(hits, p, g):
        return 2 * hits / (p + g) if hits else 0.0

    p, g = tokens(pred), tokens(gold)
    out = []
    for n in (1, 2):
        a, b = (Counter(tuple(s[i:i + n]) for i in range(len(s) - n + 1)) for s in (p, g))
        out.append(f(sum((a & b).values()), sum(a.values()), sum(b.values())))
    out.append(f(lcs(g, p)[-1][-1], len(p), len(g)))
    out.append(f(union_hits(*[[tokens(s) for s in t.split("\n") if s] for t in (gold, pred)]), len(p), len(g)))
    return out


def test_rouge(spark):
    rows = list(zip(random_texts(3, 80, "ab c\n"), random_texts(4, 80, "ab c\n")))
    rows += [("The cat sat\non the mat", "the cat\nsat on a mat"), ("가 나", "가 나")]
    got = overlap.rouge(pairs(spark, rows)).first()
    expected = [sum(column) / len(rows) for column in zip(*(rouge_reference(p, g) for p, g in rows))]
    assert [got.rouge1, got.rouge2, got.rougeL, got.rougeLsum] == pytest.approx(expected)
    korean = pairs(spark, [("가 나", "가 나")])
    assert overlap.rouge(korean).first().rouge1 == 0
    assert overlap.rouge(korean, tokenizer="whitespace").first().rouge1 == 1
    assert overlap.rouge(korean, tokenizer="char").first().rougeL == 1


def test_summary_blocks_give_the_same(spark):
    rows = list(zip(random_texts(8, 60, "ab cd\n"), random_texts(9, 60, "ab cd\n")))
    df = spark.createDataFrame([(p, [g, p[::-1], None], k) for k, (p, g) in enumerate(rows)] + [("a", [], 60), (None, ["a"], 61)],
                               "pred string, golds array<string>, k int")
    for lines in (1, 2, 1000):
        found = {r["k"]: r["rougeLsum"] for r in overlap.summary_scores(df, "pred", "golds", block_lines=lines).collect()}
        assert len(found) == 62 and found[60] == found[61] == 0
        for k, (p, g) in enumerate(rows):
            assert found[k] == pytest.approx(max(rouge_reference(p, t)[3] for t in (g, p[::-1])))


def test_summary_score_of_many_lines(spark):
    lines = 100_000
    gold = "\n".join(f"the w{k} of x{k % 997} and y{k % 1009} to" for k in range(lines))
    pred = "\n".join(f"and y{k % 1009} the w{k} to" for k in range(lines - 1, -1, -1))
    df = spark.createDataFrame([(pred, [gold])], "pred string, golds array<string>").repartition(1)
    assert 0.6 < overlap.summary_scores(df, "pred", "golds", tokenizer="whitespace").first()["rougeLsum"] < 0.9


def test_rouge_takes_the_best_reference(spark):
    df = spark.createDataFrame([("a b", ["x", "a b"]), ("a", [])], "pred string, gold array<string>")
    assert overlap.rouge(df).first().rouge1 == 0.5


def test_normalisation(spark):
    texts = ["'()‘’ A, b《c》", "  The \"X\"  (y) ‘z’ ", "<태그>", "a　b", "!"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", normalize_reading_answer(F.col("t")).alias("r"),
                     normalize_question_answer(F.col("t")).alias("q")).collect()

    def clean(text):
        return " ".join("".join(c for c in text if c not in string.punctuation).split())

    for r in rows:
        assert r.r == clean(re.sub("['\"《》<>〈〉][(][)]‘’", " ", r.t.lower()))
        spaced = "".join(" " if c in "'\"《》<>〈〉()‘’" else c for c in r.t)
        assert r.q == clean(spaced.lower())


def run_score(pred, gold):
    if gold == "":
        return float(pred == gold)
    best = max((j - i for i in range(len(pred)) for j in range(i + 1, len(pred) + 1) if pred[i:j] in gold), default=0)
    if not best:
        return 0.0
    p, r = best / len(pred), best / len(gold)
    return 2 * p * r / (p + r)


def test_longest_run_score(spark):
    rows = list(zip(random_texts(5, 200, "ab가"), random_texts(6, 200, "ab가"))) + [("", ""), ("a", ""), ("", "a")]
    df = pairs(spark, rows)
    scored = df.select("*", answers.rouge_w_char(F.col("pred"), F.col("gold")).alias("s"),
                       answers.common_run(F.col("pred"), F.col("gold")).alias("n"),
                       F.get(answers.common_runs(F.col("gold"), F.array(F.lit(None).cast("string"), F.col("pred"))), F.lit(1)).alias("m"))
    for r in scored.collect():
        assert r.s == pytest.approx(run_score(r.pred, r.gold)), r
        assert r.n == r.m


def test_reading_score(spark):
    df = spark.createDataFrame([("서울", ["서울시", "서울"]), ("x", ["y"]), ("", []), ("a", [])],
                               "prediction string, golds array<string>")
    plain = answers.reading_score(df).first()
    assert plain.exact_match == 0.25 and plain.rouge == pytest.approx(0.25)
    blank = answers.reading_score(df, blank_if_empty=True).first()
    assert blank.exact_match == 0.5 and blank.rouge == 0.5


def squad_f1(pred, gold):
    def tokens(t):
        t = "".join(c for c in t.lower() if c not in string.punctuation)
        return re.sub(r"\b(a|an|the)\b", " ", t).split()

    p, g = tokens(pred), tokens(gold)
    same = sum((Counter(p) & Counter(g)).values())
    return (2 * same / (len(p) + len(g)) if same else 0.0), float(" ".join(p) == " ".join(g))


def test_squad(spark):
    texts = [" ".join(random.Random(i).choices(["the", "a", "cat", "dog", "가", "cat."], k=i % 7)) for i in range(60)]
    rows = [(texts[i], [texts[(i * 7 + 3) % 60], texts[(i * 11 + 5) % 60]]) for i in range(60)]
    df = spark.createDataFrame(rows, "prediction string, golds array<string>")
    got = answers.squad_score(df).first()
    best = [[max(squad_f1(p, g)[k] for g in gs) for p, gs in rows] for k in (0, 1)]
    assert got.f1 == pytest.approx(100 * sum(best[0]) / 60)
    assert got.exact_match == pytest.approx(100 * sum(best[1]) / 60)


def test_report(spark):
    rows = [("b", "a"), ("a", "a"), ("zzz", "b"), ("b", "b"), ("b", "b"), ("a", "c")]
    df = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(rows)], "row_id long, pred string, gold string")
    report = {(r.kind, r.label): r for r in classification.classification_report(df).collect()}
    assert (report["class", "a"].precision, report["class", "a"].recall) == (0.5, 0.5)
    assert report["class", "b"].precision == 0.6667 and report["class", "c"].f1 == 0.0
    assert ("class", "zzz") not in report
    assert report["accuracy", None].f1 == 0.5 and report["macro avg", None].support == 6
    compat = {(r.kind, r.label): r for r in
              classification.classification_report(df, order="row_id", compat=True).collect()}
    assert compat["class", "a"].precision == 0.3333
    assert {r.label: r.first_row for r in classification.first_seen(df, "gold", "row_id").collect()} == {
        "a": 0, "b": 2, "c": 5}


def test_f1_summary_counts_predicted_only_classes(spark):
    df = pairs(spark, [("x", "a"), ("a", "a"), ("b", "b")])
    row = classification.f1_summary(classification.confusion(df)).first()
    assert row.macro_f1 == pytest.approx((2 / 3 + 1 + 0) / 3) and row.micro_f1 == pytest.approx(2 / 3)


def test_entity_f1(spark):
    rows = [("<신:PS> <신동빈:PS> <롯데:OG>", "<신:PS> <신동빈:PS> <롯데그룹:OG>"),
            ("<신:PS> <신:OG>", "<신:PS> <신:OG>"), ("none", "plain"), ("", "<a:LC>")]
    got = tagging.entity_f1(pairs(spark, rows)).first()
    # The last tag of a repeated word counts, and a prediction without entities adds one wrong entity.
    assert (got.n_correct, got.n_pred, got.n_gold) == (3, 7, 6)
    p, r = 3 / 7, 3 / 6
    assert got.f1 == pytest.approx(2 * p * r / (p + r + 1e-8))


def test_iob_line(spark):
    row = spark.range(1).select(tagging.iob_line(F.lit("<신동:PS> 가 <롯:OG>")).alias("x")).first()
    assert row.x == "B-PS I-PS B-OG"
    same = pairs(spark, [("<신동:PS>", "<신동:PS>")])
    assert tagging.iob_word_f1(same).first().chrf == pytest.approx(100)


def dep_reference(gold, pred):
    def parse(line):
        out = []
        for part in line[8:].split("▁"):
            m = re.match(r"\((.+?), ([0-9]+), ([A-Z_]+)\)", part)
            if not m:
                out.append((-2, -2))
                continue
            n = fv.DEPENDENCY_LABELS.index(m[3]) if m[3] in fv.DEPENDENCY_LABELS else -2
            out.append((int(m[2]), -3 if n >= 15 else n))
        return out

    g, p = parse(gold), parse(pred)
    p = (p + [(-2, -2)] * len(g))[:len(g)]
    return [(gh, ph, gl, pl if gh == ph else -2) for (gh, gl), (ph, pl) in zip(g, p)]


def macro(pairs_):
    classes = {x for pair in pairs_ for x in pair}
    total = 0.0
    for c in classes:
        tp = sum(g == p == c for g, p in pairs_)
        n = sum(g == c for g, _ in pairs_) + sum(p == c for _, p in pairs_)
        total += 2 * tp / n
    return total / len(classes)


def test_attachment(spark):
    rng = random.Random(8)
    names = fv.DEPENDENCY_LABELS + ["NONE"]

    def line(n):
        parts = [f"({i}/2, {rng.randint(0, 3)}, {rng.choice(names)})" if rng.random() > 0.1 else "(broken" for i in range(n)]
        return "deprel: " + "▁".join(parts)

    rows = [(line(rng.randint(1, 6)), line(rng.randint(1, 6))) for _ in range(80)] + [("deprel: ", line(2))]
    aligned = dependency.align_dependencies(pairs(spark, rows))
    expected = [dep_reference(g, p) for p, g in rows]
    got = [[tuple(w) for w in r.pairs] for r in aligned.collect()]
    assert sorted(got) == sorted(expected)
    flat = [w for row in expected for w in row]
    scores = {r.score: r for r in dependency.attachment_scores(aligned).collect()}
    assert scores["UAS"].macro_f1 == pytest.approx(100 * macro([(w[0], w[1]) for w in flat]))
    assert scores["LAS"].macro_f1 == pytest.approx(100 * macro([(w[2], w[3]) for w in flat]))
    assert scores["LAS"].micro_f1 == pytest.approx(100 * sum(w[2] == w[3] for w in flat) / len(flat))
    kept = dependency.dependency_lines(spark.createDataFrame([("deprel: (1/1, 0, NP)",), ("word_counts: 1",)], "value string"))
    assert kept.count() == 1


@pytest.mark.parametrize("gold, pred, expected", [
    ([], [], (1, 1, 1)), ([], ["a"], (0, 0, 0)), (["a"], [], (0, 0, 0)),
    (["a", "b"], ["a", "c", "c"], (0.4, 0.5, 1 / 3)), (["a", "a"], ["a"], (1, 1, 1)),
])
def test_slot_scores(spark, gold, pred, expected):
    df = spark.createDataFrame([(gold, pred)], "gold array<string>, pred array<string>")
    row = states.dialogue_state_score(df).first()
    assert (row.f1, row.recall, row.precision) == pytest.approx(expected)


def test_token_accuracy(spark):
    df = spark.createDataFrame([(0, [1, 2], [1, 3]), (0, [1, 1], [1, 1]), (1, [5], [5]), (1, [5], [4, 5])],
                               "batch_id int, pred_ids array<int>, labels array<int>")
    assert states.token_accuracy(df).first().token_accuracy == pytest.approx((3 / 4 + 1 / 3) / 2)


def test_many_entities_and_slots_in_a_row(spark):
    """Counts with repetition equal plain loops, and a row of 20,000 takes no quadratic time."""
    import random
    import time

    rng = random.Random(8)
    rows = [([(rng.choice("abc"), rng.choice(["PS", "LC"])) for _ in range(rng.randint(0, 8))],
             [(rng.choice("abcd"), rng.choice(["PS", "LC"])) for _ in range(rng.randint(0, 8))]) for _ in range(200)]
    kind = "array<struct<word:string,tag:string>>"
    df = spark.createDataFrame(rows, f"p {kind}, g {kind}")
    got = df.select(tagging.correct_entities(F.col("p"), F.col("g")).alias("n")).collect()
    assert [r.n for r in got] == [sum(dict(p).get(w) == t for w, t in g) for p, g in rows]
    words = df.select(F.transform("g", lambda e: e["word"]).alias("gold"), F.transform("p", lambda e: e["word"]).alias("pred"))
    slots = [([w for w, _ in g], [w for w, _ in p]) for p, g in rows]
    for r, (gold, pred) in zip(words.select(states.slot_scores(F.col("gold"), F.col("pred")).alias("s")).collect(), slots):
        if gold:
            tp, fp = sum(w in pred for w in gold), sum(w not in gold for w in pred)
            assert (r.s.recall, r.s.precision) == (tp / len(gold), tp / (tp + fp) if tp + fp else 0.0)
        else:
            assert r.s.f1 == float(not pred)
    nulls = spark.createDataFrame([(["a", None], ["a", None])], "gold array<string>, pred array<string>")
    assert nulls.select(states.slot_scores(F.col("gold"), F.col("pred")).alias("s")).first().s.recall == 0.5
    many = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20000)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("w"))
    started = time.time()
    entities = F.transform("w", lambda w: F.struct(w.alias("word"), F.lit("PS").alias("tag")))
    row = many.select(tagging.correct_entities(entities, F.reverse(entities)).alias("n"), states.slot_scores(F.col("w"), F.reverse("w")).alias("s")).first()
    assert row.n == 20000 and row.s.f1 == 1.0
    assert time.time() - started < 20


def test_summary_block_traces_only_what_can_count(monkeypatch):
    import random
    from collections import Counter

    from textmill.functions import overlap as sequences
    from textmill.operators.metrics import overlap as scores

    rng = random.Random(8)
    for _ in range(300):
        pred, gold = ([" ".join(rng.choices("abcdef", k=rng.randint(0, 6))) for _ in range(rng.randint(0, 8))] for _ in range(2))
        gold = gold + rng.sample(pred, len(pred) // 2)
        index = sequences.SentenceIndex(scores._sentences("\n".join(pred), "whitespace"))
        used = Counter()
        for sentence in (g.split() for g in gold):
            covered = set().union(*(sequences._lcs_positions(sentence, p) for p in index.sentences))
            used.update(range(0) if tuple(sentence) in index.known else (sentence[i] for i in covered))
            used.update(sentence if tuple(sentence) in index.known else [])
        assert scores._summary_block(index, gold, True, True, "whitespace")["hits"][0]["used"] == sum((used & index.counts).values())
        many = {h["token"]: min(h["used"], h["held"]) for h in scores._summary_block(index, gold, True, False, "whitespace")["hits"]}
        assert {t: n for t, n in many.items() if n} == dict(used & index.counts)

    # Two of three lines are in the prediction: they use up all its tokens, so the third is traced against none.
    traced = []
    trace = sequences._lcs_positions
    monkeypatch.setattr(sequences, "_lcs_positions", lambda *a: traced.append(a) or trace(*a))
    gold = [" ".join(rng.choices("abcdefghij", k=12)) for _ in range(60)]
    kept = [line for i, line in enumerate(gold) if (i + 1) % 3]
    scores._summary_block(sequences.SentenceIndex([k.split() for k in kept]), gold, True, True, "whitespace")
    assert not traced
