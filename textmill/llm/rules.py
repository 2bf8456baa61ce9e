r"""Quality rules: statistics of a text as expressions, and a decision list over them learned from labels.

No Python runs on rows: statistics, counts of the learner and the learned list are all DataFrame work.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hash_bucket, hash_unit
from ..functions.text import let
from .common import stored

SPACE = r"\x20\x09-\x0D"
WINDOW = 8
#: What conditions of the learned list compare: ratios that don't depend on the length, and the length.
MEASURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "shout_share",
            "distinct_share")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside a window of `window` words that occurs at least twice, its first place included; overlaps count once.

    Windows are compared by 64-bit hashes. Linear but for one sort, and that only in texts with a repeat.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - window + 1), lambda i: F.xxhash64(F.slice(h, i, F.lit(window))))

    def covered(g: Column) -> Column:
        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = lambda s, e, k: F.coalesce(F.get(s, k)["x"] == e["x"], F.lit(False))
        places = let(ordered, lambda s: F.filter(
            F.transform(s, lambda e, k: F.when(same(s, e, k - 1) | same(s, e, k + 1), e["i"])), lambda i: i.isNotNull()))
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(F.array_sort(places), start, lambda a, p: F.struct(
            p.alias("last"), (a["total"] + F.least(F.lit(window), p - a["last"])).alias("total")), lambda a: a["total"])

    counted = let(let(F.transform(words, lambda w: F.xxhash64(w)), windows),
                  lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(F.size(words) > window, counted).otherwise(0).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""id_col, the base statistics and `MEASURES` of every row; a null text counts as empty, an empty text gives zeros.

    Words are `[^\x20\x09-\x0D]+`. n_words and word_chars are their number and code points, n_symbols the characters of `[#*$%&|<>]`,
    n_dup_lines the lines with a word that equal an earlier one, n_repeat_words see `repeated_words`.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col), text.alias("text"), F.array_remove(F.split(text, f"[{SPACE}]+"), "").alias("words"))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    count = lambda pattern: F.regexp_count(F.col("text"), F.lit(pattern)).cast("long")
    base = split.select(
        F.col(id_col), F.size("words").cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"), let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"), count("[A-Z]").alias("upper"), count("[0-9]").alias("digits"),
        count("[!?]").alias("shouts"), F.size(F.array_distinct("words")).alias("distinct"))
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))
    return base.select(
        id_col, "n_words", "word_chars", "n_symbols", (F.col("lines.n") - F.col("lines.d")).cast("long").alias("n_dup_lines"), "n_repeat_words",
        share("word_chars", "n_words").alias("word_length"), share("n_symbols", "word_chars").alias("symbol_share"),
        F.coalesce(F.try_divide((F.col("lines.n") - F.col("lines.d")).cast("double"), F.col("lines.n")), F.lit(0.0)).alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("upper", "word_chars").alias("upper_share"),
        share("digits", "word_chars").alias("digit_share"), share("shouts", "word_chars").alias("shout_share"),
        share("distinct", "n_words").alias("distinct_share"))


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.measure).cast("double")
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction that marks poor text, with the rows it covered in pruning: poor and good."""

    conditions: tuple[Condition, ...]
    poor: int
    good: int

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (c.column() for c in self.conditions))

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def verdict(rules: list[Rule]) -> Column:
    """Whether a text is kept: false at the first rule that holds, true if none does."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(False)) if out is None else out.when(rule.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", cuts: int = 32, max_rules: int = 12,
          max_conditions: int = 3, least_precision: float = 0.97, least_rows: int = 3, seed: int = 5, most_rows: int = 20_000) -> list[Rule]:
    """Sequential covering: conjunctions of thresholds that mark rows labelled 0, the surest first.

    Two thirds of the labelled rows grow a rule, condition by condition, by the gain in information on the rows not covered yet;
    the rest prune it to the prefix with the best precision. A rule stays if it covers `least_rows` poor pruning rows and its
    smoothed precision there reaches `least_precision` or it covers no good one; else no later rule begins with the same measure, and the list ends when none is left.
    Thresholds are `cuts` quantiles of each measure in each class. Each step is one aggregation over all labelled rows, of which only counts by measure and quantile
    reach the driver. Of more than `most_rows` labelled ids a seeded share of about that many is learned from, so the work of the steps, which look at
    every labelled row again and again, is bounded. Null labels are none, an id with several labels has their mean, 0 below one half. Without labels,
    or with one class only, there are no rules.
    """
    wanted = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col)
              .agg((F.avg(F.col(label_col).cast("double")) < 0.5).cast("int").alias("poor")))
    share = most_rows / max(wanted.count(), 1)
    if share < 1:
        wanted = wanted.where(hash_unit(F.col(id_col), seed + 1) < share)
    rows = stored(stats.select(id_col, *MEASURES).join(wanted, id_col)
                  .select((hash_bucket(F.col(id_col), 3, seed) > 0).alias("grows"), "poor", *(F.col(m).cast("double") for m in MEASURES)), "labelled")
    shares = [(i + 1) / (cuts + 1) for i in range(cuts)]
    by_class = rows.groupBy("poor").agg(*(F.percentile_approx(m, shares, 10_000).alias(m) for m in MEASURES)).collect()
    if len(by_class) < 2:
        return []
    limits = {m: sorted({t for r in by_class for t in r[m]}) for m in MEASURES}
    place = lambda m: F.size(F.filter(F.array(*(F.lit(float(t)) for t in limits[m])), lambda t: t < F.col(m)))
    # place k: above the first k thresholds of the measure.
    rows = stored(rows.withColumn("places", F.array(*(place(m) for m in MEASURES))), "placed")
    rules: list[Rule] = []
    barred: set[str] = set()
    left = rows
    while len(rules) < max_rules:
        grown = _grow(left.where("grows"), limits, max_conditions, barred)
        if not grown:
            break
        rule = _prune(left.where("NOT grows"), grown)
        sure = not rule.good or (rule.poor + 1) / (rule.poor + rule.good + 2) >= least_precision
        if sure and rule.poor >= least_rows:
            rules.append(rule)
            left = left.where(~rule.column())
        else:
            barred.add(grown[0].measure)
    return rules


def _grow(rows: DataFrame, limits: dict[str, list[float]], max_conditions: int, barred: set[str]) -> list[Condition]:
    """Conditions added one by one while the rows they leave hold both classes and a condition gains."""
    conditions: list[Condition] = []  # a barred measure is never the first
    covered = rows
    while len(conditions) < max_conditions:
        counts: dict[tuple[int, int], list[int]] = {}
        for r in covered.select("poor", F.posexplode("places").alias("m", "k")).groupBy("m", "k", "poor").count().collect():
            counts.setdefault((r["m"], r["k"]), [0, 0])[r["poor"]] += r["count"]
        good = sum(v[0] for (m, _), v in counts.items() if m == 0)
        poor = sum(v[1] for (m, _), v in counts.items() if m == 0)
        if not poor or not good:
            break
        before, best, equal = math.log2(poor / (poor + good)), 0.0, []
        for m, name in enumerate(MEASURES):
            if name in barred and not conditions:
                continue
            below = [0, 0]
            for k, threshold in enumerate(limits[name]):
                own = counts.get((m, k), (0, 0))
                below = [below[0] + own[0], below[1] + own[1]]
                for above, g, p in ((False, *below), (True, good - below[0], poor - below[1])):
                    if p:
                        gain = p * (math.log2(p / (p + g)) - before)
                        if gain > best + 1e-9:
                            best, equal = gain, []
                        if gain > 0 and gain >= best - 1e-9 and (not equal or (equal[0].measure, equal[0].above) == (name, above)):
                            equal.append(Condition(name, above, threshold))
        if not equal:
            break
        conditions.append(equal[len(equal) // 2])  # of thresholds that do equally well, the middle one
        covered = covered.where(conditions[-1].column())
    return conditions


def _prune(rows: DataFrame, conditions: list[Condition]) -> Rule:
    """The prefix with the best smoothed precision on the pruning rows, the shorter of equals."""
    prefixes = [reduce(lambda a, b: a & b, (c.column() for c in conditions[:i + 1])) for i in range(len(conditions))]
    counts = rows.agg(*(F.count_if(p & (F.col("poor") == k)).alias(f"n{i}_{k}") for i, p in enumerate(prefixes) for k in (0, 1))).first()
    made = [Rule(tuple(conditions[:i + 1]), counts[f"n{i}_1"], counts[f"n{i}_0"]) for i in range(len(conditions))]
    return max(made, key=lambda r: ((r.poor + 1) / (r.poor + r.good + 2), -len(r.conditions)))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least_words: int = 20,
          repeat_percent: int = 30, **learning) -> DataFrame:
    """The statistics of every row with base_failed and kept.

    base_failed: fewer than `least_words` words, or more than `repeat_percent` % of them repeated. kept: not base_failed and no learned
    rule holds. A null or empty text fails. Rows that repeat give a row each; an empty table gives none.
    """
    stats = stored(statistics(docs, id_col, text_col), "statistics")
    rules = learn(stats, labels, id_col, label_col, **learning)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
