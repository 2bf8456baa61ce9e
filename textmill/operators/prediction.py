"""Model application, prediction parsing and alignment with the gold rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from ..functions import fixed_values as fv
from ..functions.text import let, strip

ModelLoader = Callable[[], Callable[[list[str]], list[str]]]


def clean_input(text: Column) -> Column:
    """The two characters backslash-n become a newline; the text is stripped."""
    return strip(F.replace(text, F.lit("\\n"), F.lit("\n")))


def clean_output(text: Column) -> Column:
    """Newlines are removed and the text is stripped."""
    return strip(F.replace(text, F.lit("\n"), F.lit("")))


def generator(load: ModelLoader, batch_size: int) -> Callable[[Column], Column]:
    """Column function that applies a model in batches. `load` runs once per Python worker; a null text stays null."""
    def make_predict():
        model = load()

        def predict(texts: np.ndarray) -> np.ndarray:
            flat = texts.reshape(-1)
            given = np.array([isinstance(t, str) for t in flat], dtype=bool)
            out = np.full(len(flat), None, dtype=object)
            if given.any():
                out[given] = model(list(flat[given]))
            return out

        return predict

    return predict_batch_udf(make_predict, return_type=StringType(), batch_size=batch_size)


def batch_generate(df: DataFrame, load: ModelLoader, batch_size: int = 32, text: str = "input_text",
                   out: str = "prediction") -> DataFrame:
    """Add the model's output line for each row. Works on batch and streaming frames; the row key keeps the order."""
    apply = generator(load, batch_size)
    return df.withColumn(out, clean_output(apply(clean_input(F.col(text)))))


def parse_reading_prediction(text: Column, on_missing: str = "unknown") -> Column:
    """Answer of a reading-task prediction: the first line, or the new answer of a rejecting second line.

    Without a second line the answer is the unknown mark, or with `on_missing="keep"` the first line. A second line
    that rejects without the new-answer mark gives its text after the seventh character.
    """
    def parsed(lines: Column) -> Column:
        first = F.substr(lines[0], F.lit(len(fv.OUTPUT_PREFIX) + 1))
        second = F.get(lines, F.lit(1))
        renewed = F.when(F.contains(second, F.lit(fv.NEW_ANSWER_MARK)),
                         F.substring_index(second, fv.NEW_ANSWER_MARK, -1)).otherwise(
            F.substr(second, F.lit(len(fv.NEW_ANSWER_MARK))))
        missing = F.lit(fv.UNKNOWN_ANSWER) if on_missing == "unknown" else first
        return F.when(second.isNull(), missing).when(second.startswith(fv.CORRECT_MARK), first).otherwise(renewed)

    return let(F.split(text, "\n", -1), parsed)


def gold_answers(plausible: Column, answers: Column) -> Column:
    """Answers as `(text, answer_start)`; an unanswerable question has the unknown mark at -1."""
    renamed = F.transform(answers, lambda a: F.struct(a["text"].alias("text"), a["start_idx"].alias("answer_start")))
    unknown = F.array(F.struct(F.lit(fv.UNKNOWN_ANSWER).alias("text"), F.lit(-1).alias("answer_start")))
    return F.when(plausible, unknown).otherwise(renamed)


def align(predictions: DataFrame, golds: DataFrame, key: str = "row_id", strict: bool = False) -> DataFrame:
    """Predictions next to their gold rows. `strict` fails the job if a key is missing or repeated on either side."""
    if not strict:
        return predictions.join(golds, key)
    # The count needs the partitioning and order that the join needs, so it costs no shuffle of its own.
    times = F.count("*").over(Window.partitionBy(key))
    both = predictions.withColumn("_left", times).join(golds.withColumn("_right", times), key, "full")
    once = (F.col("_left") == 1) & (F.col("_right") == 1)
    complete = F.when(once, F.lit(True)).otherwise(F.raise_error(F.concat(
        F.lit("row repeated or without counterpart: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    return both.filter(complete).drop("_left", "_right")


def alignment_report(predictions: DataFrame, golds: DataFrame, key: str = "row_id") -> DataFrame:
    """One row: keys on both sides, only predicted, only gold, and keys that repeat on a side."""
    sides = predictions.select(key, F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(
        golds.select(key, F.lit(0).alias("p"), F.lit(1).alias("g")))
    per_key = sides.groupBy(key).agg(F.sum("p").alias("p"), F.sum("g").alias("g"))
    return per_key.agg(F.count_if((F.col("p") > 0) & (F.col("g") > 0)).alias("n_both"),
                       F.count_if(F.col("g") == 0).alias("n_only_predicted"),
                       F.count_if(F.col("p") == 0).alias("n_only_gold"),
                       F.count_if((F.col("p") > 1) | (F.col("g") > 1)).alias("n_repeated"))


def lookup_by_id(golds: DataFrame, predictions: DataFrame, key: str = "qid") -> DataFrame:
    """Gold rows with their prediction; gold rows without one are left out."""
    return golds.join(predictions, key)


def label_elements(line: Column) -> Column:
    """Tagged words `<w:TT>` of a label-only prediction line."""
    return F.split(F.replace(strip(line), F.lit("> <"), F.lit(">▁<")), "▁", -1)


def retag_sentence(sentence: Column, elements: Column, boundary_rule: bool = True) -> Column:
    """Put `<w:TT>` tags back into a plain sentence, left to right from a moving cursor.

    `boundary_rule`: a word that occurs more than once from the cursor on and does not follow a boundary character is
    looked for again from the cursor plus its place on, and if what that finds does not follow one either, once more in the
    same way. Places count from 0 and -1 is "not found"; a place before the text counts from its end. So after a
    failed second search the character looked at is the last but one, and the third search begins just before the cursor. A
    word that is not found is skipped.
    """
    def find(word: Column, text: Column, start: Column) -> Column:
        """0-based position at or after the 0-based `start`, -1 if there is none."""
        return F.position(word, text, start + 1) - 1

    def find_from(word: Column, text: Column, start: Column) -> Column:
        return find(word, text, F.when(start < 0, F.greatest(F.lit(0), F.length(text) + start)).otherwise(start))

    def loose(text: Column, at: Column) -> Column:
        """Whether the character before a place is no boundary."""
        before = F.substr(text, F.when(at > 0, at).otherwise(F.length(text) + at), F.lit(1))
        return ~before.isin(fv.TAG_BOUNDARY_CHARACTERS)

    def occurrences(word: Column, text: Column, start: Column) -> Column:
        rest = F.substr(text, start + 1)
        return ((F.length(rest) - F.length(F.replace(rest, word, F.lit("")))) / F.length(word)).cast("int")

    def place(state: Column, element: Column) -> Column:
        size = F.length(element)
        word = F.substr(element, F.lit(2), size - 5)
        tag = F.substr(element, size - 2, F.lit(2))

        def put(at: Column) -> Column:
            tagged = F.concat(F.substr(state["text"], F.lit(1), at), F.lit("<"), word, F.lit(":"), tag, F.lit(">"),
                              F.substr(state["text"], at + F.length(word) + 1))
            return F.when(at >= 0, F.struct(tagged.alias("text"), (at + F.length(word) + 5).alias("cursor"))
                          ).otherwise(F.struct(state["text"].alias("text"), state["cursor"].alias("cursor")))

        def again(at: Column) -> Column:
            return F.when(loose(state["text"], at), find_from(word, state["text"], state["cursor"] + at)).otherwise(at)

        def settle(at: Column) -> Column:
            ambiguous = (occurrences(word, state["text"], state["cursor"]) > 1) & (at > 0) & loose(state["text"], at)
            return F.when(ambiguous, let(find(word, state["text"], state["cursor"] + at), again)).otherwise(at)

        first = find(word, state["text"], state["cursor"])
        at = let(first, settle) if boundary_rule else first
        return F.when(element.rlike("(?d)^<.+:..>$"), let(at, put)).otherwise(
            F.struct(state["text"].alias("text"), state["cursor"].alias("cursor")))

    start = F.struct(sentence.alias("text"), F.lit(0).alias("cursor"))
    return F.aggregate(elements, start, place, lambda state: state["text"])


def mismatch_count(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row: differing rows and all rows."""
    return df.agg(F.count_if(~F.col(left).eqNullSafe(F.col(right))).alias("n_differ"), F.count("*").alias("n_rows"))
