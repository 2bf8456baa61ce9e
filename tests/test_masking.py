import random
import re

import pytest
from pyspark.sql import functions as F

from textmill.operators import masking
from textmill.plans.corpus import salient_span_corpus, write_corpus


def capitals(sentence):
    return F.regexp_extract_all(sentence, F.lit("[A-Z]+"), 0)


def documents(spark, n=60):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        sentences = ["".join(rng.choice("AB cde 가") for _ in range(rng.randint(1, 300))).strip() + "."
                     for _ in range(rng.randint(0, 15))]
        rows.append((i, " ".join(sentences)))
    rows += [(n, rows[3][1]), (n + 1, ""), (n + 2, "x" * 3000 + "AB. C."), (n + 3, "no entity. at all.")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def corpus_reference(rows, variants, compat=False):
    out, seen = {}, set()
    for doc_id, text in rows:
        if text in seen:
            continue
        seen.add(text)
        sentences = [s for s in re.sub("([.?!]) ", "\\1\n", text).split("\n") if s]
        contexts, used = [], 0
        for s in sentences:
            size = len(s.encode())
            if not contexts or used + size > 1024:
                contexts.append([])
                used = 0
            contexts[-1].append(s)
            used += size
        for c, context in enumerate(contexts):
            for v in range(variants):
                number, texts, targets = 0, [], []
                for s in context:
                    cut = s
                    pieces, target = list(cut), ""
                    for surface in re.findall("[A-Z]+", cut)[v::variants]:
                        # Masked places hold a list, which no text matches.
                        joined = "".join(p if isinstance(p, str) else "\0" for p in pieces)
                        at = joined.find(surface)
                        if at >= 0:
                            pieces[at:at + len(surface)] = [[number]]
                        target += f"<extra_id_{number}>{surface}"
                        number += 1
                    close = "" if compat else ">"
                    texts.append("".join(p if isinstance(p, str) else f"<extra_id_{p[0]}{close}" for p in pieces))
                    targets.append(target)
                out[doc_id, c, v] = (" ".join(texts), " ".join(targets))
    return out


@pytest.mark.parametrize("variants, compat", [(2, False), (3, False), (2, True)])
def test_corpus(spark, variants, compat):
    rows, df = documents(spark)
    got = {(r.doc_id, r.context_no, r.variant): (r.text, r.label) for r in
           salient_span_corpus(df, tagger=capitals, variants=variants, compat=compat).collect()}
    assert got == corpus_reference(rows, variants, compat)


def test_entity_table_gives_the_same_corpus(spark):
    _, df = documents(spark)
    entities = masking.sentence_rows(df).select(
        "doc_id", "sent_no", F.posexplode(capitals(F.col("sentence"))).alias("ent_no", "surface"))
    table = salient_span_corpus(df, entities=entities.repartition(5))
    tagged = salient_span_corpus(df, tagger=capitals)
    assert set(map(tuple, table.collect())) == set(map(tuple, tagged.collect()))


def test_contexts_respect_the_limit_and_keep_all_sentences(spark):
    rows, df = documents(spark)
    contexts = masking.pack_contexts(df).collect()
    for r in contexts:
        size = sum(len(s.sentence.encode()) for s in r.sentences)
        assert size <= 1024 or len(r.sentences) == 1
    kept = {}
    for r in sorted(contexts, key=lambda r: (r.doc_id, r.context_no)):
        kept.setdefault(r.doc_id, []).extend(s.sentence for s in r.sentences)
    assert {k: " ".join(v) for k, v in kept.items()} == {i: t for i, t in rows if t}


def test_unmasking_restores_the_text(spark):
    df = spark.createDataFrame([(0, "AB met CD. EF saw AB and AB."), (1, "X Y Z.")], "doc_id long, text string")
    for r in salient_span_corpus(df, tagger=capitals, variants=1).collect():
        text = r.text
        for number, surface in re.findall("<extra_id_([0-9]+)>([A-Z]+)", r.label):
            text = text.replace(f"<extra_id_{number}>", surface)
        assert text == {0: "AB met CD. EF saw AB and AB.", 1: "X Y Z."}[r.doc_id]


def test_digits_do_not_match_inside_sentinels(spark):
    mask = masking.mask_sentence(F.lit("Ann has 0 and 1"), F.array(F.lit("Ann"), F.lit("0"), F.lit("id")), F.lit(0))
    row = spark.range(1).select(mask.alias("m")).first().m
    assert row.text == "<extra_id_0> has <extra_id_1> and 1"
    assert row.target == "<extra_id_0>Ann<extra_id_1>0<extra_id_2>id"


def test_tagged_surfaces_and_output(spark, folder):
    row = spark.range(1).select(masking.tagged_surfaces(F.lit("<가:PS> x <나:LC>")).alias("x")).first()
    assert row.x == ["가", "나"]
    _, df = documents(spark, 5)
    write_corpus(salient_span_corpus(df, tagger=capitals), f"{folder}/corpus")
    assert spark.read.json(f"{folder}/corpus").columns == ["label", "text"]
    with pytest.raises(ValueError):
        salient_span_corpus(df)


def test_many_entities_in_a_long_sentence(spark):
    """20,000 entities in a sentence of about a megabyte."""
    words = [f"Word{i}x{'y' * (i % 80)}" for i in range(20000)]
    df = spark.createDataFrame([(" ".join(words), words)], "s string, e array<string>")
    m = df.select(masking.mask_sentence(F.col("s"), F.col("e"), F.lit(0)).alias("m")).first().m
    assert m.text == " ".join(f"<extra_id_{i}>" for i in range(20000))
    assert m.target == "".join(f"<extra_id_{i}>{w}" for i, w in enumerate(words))


def test_masking_odd_entities(spark):
    rows = [("aaa aa", ["aa", "a", "aa", "aa"]), ("", ["x"]), ("abcabc", ["bc", "abc", "", None, "abc"]), (None, ["x"]), ("a", None)]
    df = spark.createDataFrame(rows, "s string, e array<string>")
    got = [r.m for r in df.select(masking.mask_sentence(F.col("s"), F.col("e"), F.lit(3)).alias("m")).collect()]
    assert got[0].text == "<extra_id_3><extra_id_4> <extra_id_5>"
    assert got[0].target == "<extra_id_3>aa<extra_id_4>a<extra_id_5>aa<extra_id_6>aa"
    assert tuple(got[1]) == ("", "<extra_id_3>x")
    assert got[2].text == "a<extra_id_3><extra_id_4>"
    assert got[3] is None and got[4] is None
