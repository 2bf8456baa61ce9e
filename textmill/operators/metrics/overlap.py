"""Corpus chrF and ROUGE: per-row statistics in Arrow batches, then one aggregation.

No n-gram ever leaves its row, so the text is not shuffled and a long document costs only its own length. The summary score of
a document of many lines is computed in blocks of lines, which meet in sums by token.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ...functions import fixed_values as fv
from ...functions.overlap import code_points, lcs_length, ngram_counts, token_ids, SentenceIndex

_PUNCTUATION = frozenset(fv.ASCII_PUNCTUATION)


def _chrf_words(text: str) -> list[str]:
    """Words with one leading or trailing punctuation mark split off."""
    tokens = []
    for word in text.split():
        if len(word) > 1 and word[-1] in _PUNCTUATION:
            tokens += [word[:-1], word[-1]]
        elif len(word) > 1 and word[0] in _PUNCTUATION:
            tokens += [word[0], word[1:]]
        else:
            tokens.append(word)
    return tokens


def _chrf_row(pred: str, gold: str, char_order: int, word_order: int) -> list[int]:
    totals = []
    if char_order:
        totals += ngram_counts(code_points("".join(pred.split())), code_points("".join(gold.split())), char_order)
    if word_order:
        totals += ngram_counts(*token_ids(_chrf_words(pred), _chrf_words(gold)), word_order)
    # Predicted n-grams do not count where the reference has none of that order.
    return [n for p, r, m in totals for n in (p if r else 0, r, m)]


def chrf_statistics(pred: Column, gold: Column, char_order: int = 6, word_order: int = 0) -> Column:
    """Per row, (predicted, reference, matching) totals for each character order, then each word order."""
    @F.pandas_udf("array<bigint>")
    def statistics(preds: pd.Series, golds: pd.Series) -> pd.Series:
        return pd.Series([_chrf_row(p, g, char_order, word_order) for p, g in zip(preds, golds)], dtype=object)

    return statistics(F.coalesce(pred, F.lit("")), F.coalesce(gold, F.lit("")))


def chrf_sums(statistics: str, orders: int, prefix: str = "_s") -> list[Column]:
    """Corpus totals of a statistics column, as aggregates `_s0, _s1, …`."""
    return [F.coalesce(F.sum(F.col(statistics)[i]), F.lit(0)).alias(f"{prefix}{i}") for i in range(3 * orders)]


def chrf_score(orders: int, beta: float, prefix: str = "_s") -> Column:
    """Score in 0..100 from the totals: precision and recall averaged over the orders present on both sides."""
    precision, recall, effective = F.lit(0.0), F.lit(0.0), F.lit(0)
    for order in range(orders):
        p, r, m = (F.col(f"{prefix}{3 * order + i}") for i in range(3))
        usable = (p > 0) & (r > 0)
        precision = precision + F.when(usable, m / p).otherwise(0.0)
        recall = recall + F.when(usable, m / r).otherwise(0.0)
        effective = effective + usable.cast("int")
    factor = beta ** 2
    # The common divisor of both means cancels out of the quotient except once.
    score = 100 * (1 + factor) * precision * recall / (factor * precision + recall) / effective
    return F.when(precision + recall > 0, score).otherwise(0.0)


def chrf(df: DataFrame, pred: str = "pred", gold: str = "gold", char_order: int = 6, word_order: int = 0,
         beta: float = 2.0) -> DataFrame:
    """One row with the corpus-level `chrf` score in 0..100."""
    orders = char_order + word_order
    stats = df.select(chrf_statistics(F.col(pred), F.col(gold), char_order, word_order).alias("_stats"))
    sums = stats.agg(F.count("*").alias("n_rows"), *chrf_sums("_stats", orders))
    return sums.select(chrf_score(orders, beta).alias("chrf"), "n_rows")


def _tokenize(text: str, tokenizer: str) -> list[str]:
    if tokenizer == "ascii":
        return re.findall("[a-z0-9]+", text.lower())
    if tokenizer == "whitespace":
        return text.split()
    if tokenizer == "char":
        return [c for c in text if not c.isspace()]
    raise ValueError(f"unknown tokenizer {tokenizer!r}")


def _f1(hits: int, pred: int, gold: int) -> float:
    return 2.0 * hits / (pred + gold) if hits else 0.0


ROUGE_TYPES = ("rouge1", "rouge2", "rougeL", "rougeLsum")


def _rouge_row(pred: str, gold: str, tokenizer: str, types: Sequence[str]) -> list[float]:
    p, g = _tokenize(pred, tokenizer), _tokenize(gold, tokenizer)
    scores = {}
    if {"rouge1", "rouge2"} & set(types):
        one, two = ngram_counts(*token_ids(p, g), 2)
        scores["rouge1"], scores["rouge2"] = (_f1(m, n, r) for n, r, m in (one, two))
    if "rougeL" in types:
        scores["rougeL"] = _f1(lcs_length(p, g), len(p), len(g))
    return [scores[t] for t in types]


def rouge_statistics(pred: Column, golds: Column, tokenizer: str = "ascii", types: Sequence[str] = ROUGE_TYPES[:3]) -> Column:
    """Per row F1 of the `types` asked for, each the best over the gold texts; only these are computed. For rougeLsum see `summary_scores`."""
    @F.pandas_udf(", ".join(f"{t} double" for t in types))
    def statistics(preds: pd.Series, gold_lists: pd.Series) -> pd.DataFrame:
        rows = []
        for p, gs in zip(preds, gold_lists):
            scores = [_rouge_row(p, g, tokenizer, types) for g in gs]
            rows.append([max(s) for s in zip(*scores)] if scores else [0.0] * len(types))
        return pd.DataFrame(rows, columns=list(types), dtype="float64")

    return statistics(F.coalesce(pred, F.lit("")), F.filter(golds, lambda g: g.isNotNull()))


def _sentences(text: str, tokenizer: str) -> list[list[str]]:
    return [t for t in (_tokenize(line, tokenizer) for line in text.split("\n")) if t]


_SUMMARY_BLOCK = ("struct<n_pred: bigint, n_gold: bigint, "
                  "hits: array<struct<token: string, used: bigint, held: bigint>>>")


def _summary_block(index: SentenceIndex, gold: Sequence[str], first: bool, only: bool, tokenizer: str) -> dict:
    sentences = [t for t in (_tokenize(line, tokenizer) for line in gold) if t]
    used: Counter = Counter()
    # Sentences that the prediction has cost nothing and may use up what it holds of a token: then none of its places need be traced.
    for sentence in sorted(sentences, key=lambda s: tuple(s) not in index.known):
        used.update(index.union(sentence, used))
    if only:
        same = sum((used & index.counts).values())
        hits = [{"token": None, "used": same, "held": same}]
    else:
        # What the prediction holds comes once, with the first block.
        tokens = used.keys() | index.counts.keys() if first else used.keys()
        hits = [{"token": t, "used": used[t], "held": index.counts[t] if first else 0} for t in tokens]
    return {"n_pred": sum(index.counts.values()), "n_gold": sum(map(len, sentences)), "hits": hits}


def summary_scores(df: DataFrame, pred: str, golds: str, tokenizer: str = "ascii", block_lines: int = 1024) -> DataFrame:
    """`_row`, the other columns of `df` and rougeLsum, the best F1 over the gold texts (an array; 0 if it is empty).

    A gold line counts the places of its tokens in the union of its common subsequences with all predicted lines; over the text, a token
    counts at most as often as the prediction holds it: a sum of least(used, held) by token. So lines are independent
    up to that sum. A gold text is cut into blocks of `block_lines` lines, each of which meets the prediction by an index from
    tokens to lines; a text of one block sends one number, those of more send their token counts. `_row` is only unique.
    """
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    texts = rows.select("*", F.posexplode_outer(F.filter(golds, lambda g: g.isNotNull())).alias("_gold_no", "_gold"))
    lines = texts.withColumn("_lines", F.split("_gold", "\n", -1)).withColumn("_blocks", F.ceil(F.size("_lines") / block_lines).cast("int"))
    blocks = lines.select(
        *df.columns, "_row", "_gold_no", "_lines", "_blocks",
        F.explode_outer(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block")).withColumn(
        "_lines", F.slice("_lines", F.col("_block") * block_lines + 1, F.lit(block_lines)))

    @F.pandas_udf(_SUMMARY_BLOCK)
    def counted(preds: pd.Series, gold_lines: pd.Series, numbers: pd.Series, of: pd.Series) -> pd.DataFrame:
        made, last, index = [], None, None
        for text, gold, number, n in zip(preds, gold_lines, numbers, of):
            if index is None or text != last:
                last, index = text, SentenceIndex(_sentences(text, tokenizer))
            made.append(_summary_block(index, [] if gold is None else gold, number == 0, not n > 1, tokenizer))
        return pd.DataFrame(made, columns=["n_pred", "n_gold", "hits"])

    found = blocks.withColumn("_found", counted(F.coalesce(F.col(pred), F.lit("")), "_lines", "_block", "_blocks"))
    kept = [F.first(c).alias(c) for c in df.columns if c not in (pred, golds)]
    others = [c for c in df.columns if c not in (pred, golds)]
    size = found.select(*others, "_row", "_gold_no", F.col("_found.n_pred").alias("_p"), F.col("_found.n_gold").alias("_g"),
                        F.posexplode_outer("_found.hits").alias("_at", "_counted"))
    # Sizes count once for each block: with its first token, or with none.
    counts = size.groupBy("_row", "_gold_no", F.col("_counted.token").alias("_token")).agg(
        *kept, F.sum("_counted.used").alias("_used"), F.sum("_counted.held").alias("_held"), F.max("_p").alias("_p"),
        F.sum(F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_g")).otherwise(0)).alias("_g"))
    texts = counts.groupBy("_row", "_gold_no").agg(
        *kept, F.sum(F.least("_used", "_held")).alias("_hits"), F.max("_p").alias("_p"), F.sum("_g").alias("_g"))
    f1 = F.when(F.col("_hits") > 0, 2.0 * F.col("_hits") / (F.col("_p") + F.col("_g"))).otherwise(0.0)
    return texts.groupBy("_row").agg(*kept, F.max(f1).alias("rougeLsum"))


def with_rouge(df: DataFrame, pred: str, golds: str, tokenizer: str = "ascii", types: Sequence[str] = ROUGE_TYPES) -> DataFrame:
    """Add the `types` asked for as columns, each the best F1 over the gold texts, in place of the texts; rows may move."""
    within = [t for t in types if t != "rougeLsum"]
    if within:
        df = df.withColumn("_within", rouge_statistics(F.col(pred), F.col(golds), tokenizer, within))
        df = df.withColumns({t: F.col(f"_within.{t}") for t in within}).drop("_within")
    return summary_scores(df, pred, golds, tokenizer) if "rougeLsum" in types else df.drop(pred, golds)


def rouge(df: DataFrame, pred: str = "pred", gold: str = "gold", tokenizer: str = "ascii",
          types: Sequence[str] = ROUGE_TYPES) -> DataFrame:
    """One row of mean F1 values of the `types` asked for; `gold` is a text or a list of texts.

    The default tokenizer keeps `[a-z0-9]` only, so text in other scripts scores 0 with it.
    """
    golds = F.col(gold) if df.schema[gold].dataType.typeName() == "array" else F.array(F.col(gold))
    rows = with_rouge(df.select(F.col(pred).alias("_pred"), golds.alias("_golds")), "_pred", "_golds", tokenizer, types)
    return rows.agg(*[F.avg(n).alias(n) for n in types], F.count("*").alias("n_rows"))
