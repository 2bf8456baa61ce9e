"""Rows to `(input_text, target_text)`: narrow projections, one per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.hashing import hash32, hash_bucket
from ..functions.text import char_from_code, let, render
from .labels import LabelMap, map_labels

_CARRIED = ("row_id", "copy_no", "split")


def _emit(df: DataFrame, input_text: Column, target_text: Column) -> DataFrame:
    carried = [c for c in _CARRIED if c in df.columns]
    return df.select(*carried, input_text.alias("input_text"), target_text.alias("target_text"))


def format_plain(df: DataFrame, input_col: str = "text", label_col: str = "label",
                 label_map: LabelMap | None = None) -> DataFrame:
    mapped = map_labels(df, label_col, label_map, "_target")
    return _emit(mapped, F.col(input_col), F.col("_target"))


def format_template(df: DataFrame, input_col: str, label_col: str, input_template: str = fv.DEFAULT_INPUT,
                    label_template: str = fv.DEFAULT_LABEL, label_map: LabelMap | None = None) -> DataFrame:
    """`{{ input }}` and `{{ label }}` templates. Without a label map the label is passed through as it is."""
    mapped = map_labels(df, label_col, label_map, "_target")
    target = F.col("_target")
    if label_map is not None:
        target = render(label_template, label=target)
    return _emit(mapped, render(input_template, input=F.col(input_col)), target)


def _format_mapped(df: DataFrame, template: str, columns: dict[str, str], label_col: str,
                   label_map: LabelMap | None) -> DataFrame:
    mapped = map_labels(df, label_col, label_map, "_target")
    return _emit(mapped, render(template, **{name: F.col(c) for name, c in columns.items()}), F.col("_target"))


def format_nli(df: DataFrame, premise: str = "premise", hypothesis: str = "hypothesis", label: str = "label",
               label_map: LabelMap | None = None, classes: Sequence[str] = fv.NLI_CLASSES) -> DataFrame:
    """Class ids follow the class-name table of the source, `classes`, so that ids and target words can never disagree."""
    by_id = {i: fv.NLI_TARGETS[name] for i, name in enumerate(classes)}
    return _format_mapped(df, fv.NLI_INPUT, {"premise": premise, "hypothesis": hypothesis}, label,
                          by_id if label_map is None else label_map)


def format_topic(df: DataFrame, title: str = "title", label: str = "label",
                 label_map: LabelMap | None = None) -> DataFrame:
    return _format_mapped(df, fv.TOPIC_INPUT, {"title": title}, label, label_map or fv.TOPIC_TARGETS)


def format_paraphrase(df: DataFrame, sentence1: str = "sentence1", sentence2: str = "sentence2",
                      label: str = "label", label_map: LabelMap | None = None) -> DataFrame:
    return _format_mapped(df, fv.PARAPHRASE_INPUT, {"sentence1": sentence1, "sentence2": sentence2}, label,
                          label_map or fv.PARAPHRASE_TARGETS)


def format_title_content(df: DataFrame, title: str = "title", content: str = "content", label: str = "label",
                         label_map: LabelMap | None = None) -> DataFrame:
    return _format_mapped(df, fv.TITLE_CONTENT_INPUT, {"title": title, "content": content}, label, label_map)


def format_qa(df: DataFrame, question: str = "question", context: str = "context", answer: str = "label") -> DataFrame:
    """The target is the whole answer text, empty if there is none."""
    prompt = render(fv.QA_INPUT, question=F.col(question), context=F.col(context))
    return _emit(df, prompt, F.coalesce(F.col(answer), F.lit("")))


def corrupt_answer(answer: Column, key: Column, seed: int) -> Column:
    """Replace one character: a digit by another digit, anything else by a drawn Hangul syllable."""
    def changed(value: Column) -> Column:
        place = (F.pmod(hash32(key, f"{seed}:place"), F.length(value)) + 1).cast("int")
        old = F.substr(value, place, F.lit(1))
        is_digit = old.rlike("^[0-9]$")
        digit = (old.try_cast("int") + 1 + hash_bucket(key, 9, f"{seed}:digit")) % 10
        letter = char_from_code(F.lit(fv.HANGUL_FIRST) + hash_bucket(key, fv.HANGUL_END - fv.HANGUL_FIRST,
                                                                     f"{seed}:letter"))
        return F.overlay(value, F.when(is_digit, digit.cast("string")).otherwise(letter), place, F.lit(1))

    return F.when(F.length(answer) > 0, let(answer, changed)).otherwise(answer)


def deliberation_target(answer: Column, unanswerable: Column, key: Column, seed: int) -> Column:
    """Target text of the reading task: a first output, followed by a verdict or a new answer.

    The draws depend on the row key and the seed. About 3 % of the answers, and one in ten of those with a digit,
    are first shown corrupted; a fifth are first withheld; four fifths of the unanswerable ones are plain.
    """
    choice = hash_bucket(key, 100, f"{seed}:choice")
    digit_draw = hash_bucket(key, fv.CORRUPT_DIGIT_ONE_IN, f"{seed}:digit-draw")
    unknown, output = F.lit(fv.UNKNOWN_ANSWER), F.lit(fv.OUTPUT_PREFIX)
    right, again = F.lit(f"\n{fv.CORRECT_MARK}"), F.lit(f"\n{fv.WRONG_MARK}{fv.NEW_ANSWER_MARK}")
    without = F.when(choice > fv.UNANSWERABLE_PLAIN_ABOVE, F.concat(output, unknown, right)).otherwise(
        F.concat(output, answer, again, unknown))
    corrupted = (choice < fv.CORRUPT_BELOW) | (answer.rlike("[0-9]") & (digit_draw < 1))
    with_answer = (
        F.when(corrupted, F.concat(output, corrupt_answer(answer, key, seed), again, answer))
        .when(choice < fv.WITHHOLD_BELOW, F.concat(output, unknown, again, answer))
        .otherwise(F.concat(output, answer, right)))
    return F.when(unanswerable, without).otherwise(with_answer)


def format_mrc(df: DataFrame, question: str = "question", context: str = "context", answer: str = "answers.text",
               unanswerable: str = "plausible_answer", seed: int = 0, key: str = "row_id") -> DataFrame:
    prompt = render(fv.MRC_INPUT, question=F.col(question), context=F.col(context))
    # Repeated copies of a row draw independently.
    draw_key = F.concat_ws("#", key, "copy_no") if "copy_no" in df.columns else F.col(key)
    text = F.coalesce(F.col(answer), F.lit(""))
    return _emit(df, prompt, deliberation_target(text, F.col(unanswerable), draw_key, seed))


def squeeze_repeats(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "ㅋ+", "ㅋ"), ";+", ";")


def untag(text: Column) -> Column:
    return F.regexp_replace(text, "(?d)<(.+?):[A-Z][A-Z]>", "$1")


def format_ner(df: DataFrame, tagged: str = "tagged_sent", only_tags: bool = False) -> DataFrame:
    """Plain sentence to tagged sentence, or with `only_tags` to the tagged words alone."""
    sentence = squeeze_repeats(F.col(tagged))
    tags = F.array_join(F.regexp_extract_all(sentence, F.lit("(?d)<.+?:[A-Z][A-Z]>"), 0), " ")
    return _emit(df, render(fv.NER_INPUT, sentence=untag(sentence)), tags if only_tags else sentence)


def build_dependency_strings(df: DataFrame) -> DataFrame:
    """Add `ma_out`, one line per word, and `label`, the relations followed by the word count."""
    rows = F.arrays_zip("index", "word_form", "lemma", "pos", "head", "deprel")

    def word_line(r: Column) -> Column:
        lemmas, tags = F.split(r["lemma"], " ", -1), F.split(r["pos"], "\\+", -1)
        first = F.concat(lemmas[0], F.lit(":"), tags[0])
        last = F.concat(F.element_at(lemmas, -1), F.lit(":"), F.element_at(tags, -1))
        ending = F.when(F.size(tags) == 1, F.lit("NONE")).otherwise(last)
        return F.concat(F.concat_ws("/", r["index"].cast("string"), r["word_form"],
                                    F.length(r["word_form"]).cast("string"), r["lemma"], r["pos"], first, ending),
                        F.lit("\n"))

    def relation(r: Column) -> Column:
        return F.concat(F.lit("("), r["index"].cast("string"), F.lit("/"), F.length(r["word_form"]).cast("string"),
                        F.lit(", "), r["head"].cast("string"), F.lit(", "), r["deprel"], F.lit(")"))

    label = F.concat(F.lit("deprel: "), F.array_join(F.transform(rows, relation), "▁"),
                     F.lit("\nword_counts: "), F.size("word_form").cast("string"))
    return df.withColumns({"ma_out": F.array_join(F.transform(rows, word_line), ""), "label": label})


def format_dependency(df: DataFrame, sentence: str = "sentence", ma_out: str = "ma_out",
                      label: str = "label") -> DataFrame:
    return _emit(df, render(fv.DEPENDENCY_INPUT, sentence=F.col(sentence), ma_out=F.col(ma_out)), F.col(label))
