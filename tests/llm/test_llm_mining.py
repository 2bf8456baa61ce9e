"""Collocations, web archives and centroid clusters against plain Python, with odd rows."""

import base64
import collections
import hashlib
import math
import re
import struct

import numpy as np
import pytest
import zstandard
from textmill.llm import centroids, phrases, warc


def plain_phrases(rows, least, most):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for m in range(1, 6):
                counts[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = set()
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
        kept = [p for p, a in frequent.items() if not any(len(q) > len(p) and b >= a and inside(p, q) for q, b in frequent.items())]
        made = []
        for p in kept:
            cuts = [(1000 * f[p] * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            made.append((-score, -f[p], " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(made)[:most], 1):
            out.add((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return out


def test_collocations(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["the", "The", "of", "new", "york", "été", "a\x01b", "x" * 40, "b", "c\xa0d", "e,", "f.", "g\tg", "h\n", "i\r\x0bj", "k;l"]
    rows = [(lang, " ".join(rng.choice(words, rng.integers(0, 60)))) for lang in ("en", "de", None, "und") for _ in range(60)]
    rows += [("en", "same line of words again and again"), ("en", None), (None, ""), ("fr", " \t\n"), ("fr", "only once here")] * 7
    rows += [("en", "new york " * 3000), ("de", "b " * 50 + ".".join(["the of new"] * 500))]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, chunk int, part string")
    for small in (False, True):
        if small:  # several chunks, spills, bursts and parts
            for name, value in (("CHUNK", 500), ("SEGMENT", 300), ("PART_BYTES", 4000), ("LIMIT", 200), ("BURST", 16), ("BLOCK", 64)):
                monkeypatch.setattr(phrases, name, value)
        for least, most in ((5, 40), (7, 2000)):
            found = phrases.collocations(frame, least=least, most=most).collect()
            assert {tuple(r) for r in found} == plain_phrases(rows, least, most)
            assert len(found) == len({tuple(r) for r in found})
    assert phrases.collocations(frame.limit(0)).collect() == []
    assert phrases.collocations(frame.where("lang = 'fr'"), least=100).collect() == []


@pytest.mark.parametrize("width,limit,burst,high", [(2, 50, 8, 9), (5, 200, 4, 4), (5, 3000, 64, 300), (2, 10**6, 4, 1)])
def test_trie_counts_and_spills_in_order(width, limit, burst, high):
    rng = np.random.default_rng(1)
    rows = rng.integers(0, high, (5000, width)) + (rng.random((5000, width)) < 0.01) * 70000
    trie = phrases.HatTrie(width, limit, burst)
    runs = [run for at in range(0, 5000, 500) for run in trie.add(rows[at:at + 500])]
    runs += list(trie.rest())
    assert trie.entries == 0
    total = collections.Counter()
    for table, counts in runs:
        assert [tuple(x) for x in table.tolist()] == sorted(set(map(tuple, table.tolist())))
        for row, n in zip(table.tolist(), counts.tolist()):
            total[tuple(row)] += n
    assert total == collections.Counter(map(tuple, rows.tolist()))


def test_archives_read_back(spark, folder):
    long = "<p>" + "lorem ipsum %d " * 3000 + "</p>"
    rows = [(k, f"http://e.org/{k}?a=b c\r\nX: y&é", f"<html><body>page {k % 40} {'words and ' * (k % 7)}</body></html>", "x") for k in range(300)]
    rows += [(1000, None, None, "x"), (1001, "", "", "x"), (1002, "u", long, "x"), (1003, "u", long, "x"), (1002, "u", long, "x"),
             (None, "u", long, "x"), (None, "u", "alone", "x"), (None, "v", "alone", "x"), (7, "u", "twice", "x"), (7, "u", "twice", "x"), (1004, "u", "\r\n\r\nWARC/1.1\r\n é🙂", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, owner string")
    first = {}
    for key, _, html, _ in rows:
        if key is not None:
            first[html or ""] = min(key, first.get(html or "", key))
    for least in (0, 40):
        for limit in (20_000, warc.ARCHIVE_BYTES):
            path = warc.archive_pages(pages, f"{folder}/{least}-{limit}", min_bytes=least, archive_bytes=limit)
            found = collections.Counter((r["key"], r["record_type"], r["payload"] and bytes(r["payload"]), r["payload_bytes"], r["payload_sha1"], r["refers_to"])
                                        for r in warc.read_archives(spark, path).collect())
            expected = collections.Counter()
            for key, _, html, _ in rows:
                data = (html or "").encode()
                owner = first.get(html or "")
                again = len(data) >= least and owner is not None and owner != key
                expected[(None if key is None else str(key), "revisit" if again else "response", None if again else data, len(data),
                          hashlib.sha1(data).hexdigest(), str(owner) if again else None)] += 1
            assert {(*k[:2], k[2] or None, *k[3:]): n for k, n in found.items()} == {(*k[:2], k[2] or None, *k[3:]): n for k, n in expected.items()}
    empty = warc.archive_pages(pages.limit(0), f"{folder}/empty")
    assert warc.read_archives(spark, empty).collect() == []


def test_archive_layout():
    payloads = [f"<html>{k} and some text that repeats in every record {k * k}</html>".encode() * 20 for k in range(200)]
    records = [warc.record_bytes(str(k), "response", "http://a", p, len(p), hashlib.sha1(p).hexdigest(), None, "2020-01-01T00:00:00Z") for k, p in enumerate(payloads)]
    data = warc.packed_archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.DICTIONARY_FRAME
    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8:8 + size]))
    assert known.dict_id() > 0
    # Each record is a frame of its own.
    rest, found = data[8 + size:], []
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
        found.append(one.decompress(rest))
        rest = one.unused_data
    assert found == records
    assert [r[3] for r in warc.read_archive(data)] == payloads
    few = warc.packed_archive(records[:3])
    assert few.startswith(warc.ZSTD_FRAME) and len(list(warc.read_archive(few))) == 3
    broken = [records[0].replace(b"repeats", b"REPEATS")]
    with pytest.raises(ValueError):
        list(warc.read_archive(warc.packed_archive(broken)))
    assert warc.bare_digest(hashlib.sha1(b"").hexdigest()) == base64.b32encode(hashlib.sha1(b"").digest()).decode()


def plain_clusters(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < (1 << 27) // scale for x in v)]
    text = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (text(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    best = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        of = [best(v) for _, v in kept]
        for c in range(len(centres)):
            own = [v for (_, v), b in zip(kept, of) if b == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own)]
    of = [best(v) for _, v in kept]
    cost = [far(v, centres[c]) for (_, v), c in zip(kept, of)]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return collections.Counter((i, c, d, sum(e for e, o in zip(cost, of) if o == c), sum(cost), names[c]) for (i, _), c, d in zip(kept, of, cost))


def test_centroid_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=6) + 3 * (k % 3)).tolist()) for k in range(120)]
    rows += [(200 + k, rows[k][1]) for k in range(30)] + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, [0.0] * 6)]
    odd = [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (304, [float("nan")] * 6), (305, [float("inf")] * 6), (306, [-1e30] * 6), (307, [-0.0005] * 6)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<double>, cluster int, distance string")
    for k, rounds, width in ((8, 10, 8), (3, 2, 4), (1, 1, 1), (500, 2, 3)):
        found = centroids.cluster_vectors(frame, k=k, rounds=rounds, dims=6, width=width).collect()
        assert collections.Counter(map(tuple, found)) == plain_clusters(rows + odd, k, rounds, 6, 1024, 3)
    assert centroids.cluster_vectors(frame.limit(0), dims=6).collect() == []
    assert centroids.cluster_vectors(frame, dims=7).collect() == []


def test_lines_of_rows_that_repeat_an_id(spark):
    from textmill.llm import line_dedup

    rows = [(1, "first common line here\nown line a", 1, 2, "p"), (2, "first common line here\nown line of two", 1, 2, "p"),
            (2, "precious line alpha\nprecious line beta", 1, 2, "p"), (3, "  Precious line ALPHA ", 1, 2, "p")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _lines int, _gone int, _Dropped string")
    found = line_dedup.dedup_lines(frame)
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in found.collect()) == [
        (1, rows[0][1], 2, 0), (2, "own line of two", 2, 1), (2, rows[2][1], 2, 0), (3, "", 1, 1)]
    assert found.columns == [*frame.columns, "n_lines", "n_dropped"]


def test_common_line_is_a_join_that_spark_splits(spark):
    from pyspark.sql import functions as F
    from textmill.llm import line_dedup

    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        docs = spark.range(0, 60_000, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit("one line that all share\nown line "), F.col("id").cast("string")).alias("text"))
        result = line_dedup.dedup_lines(docs)
        rows = result.agg(F.sum("n_dropped").alias("n"), F.count("*").alias("all")).select("n", "all")
        assert tuple(rows.first()) == (59_999, 60_000)
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan()
        assert "skew=true" in plan.toString() or "skewed" in plan.toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
