"""Question-answer corpora in the nested reading-comprehension layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import let, split_passage

NESTED_SCHEMA = (
    "version string, data array<struct<title:string, paragraphs:array<struct<context:string, qas:array<struct<"
    "id:string, question:string, answers:array<struct<text:string,answer_start:int>>>>>>>>"
)
FLAT_SCHEMA = (
    "id string, type string, text1 string, text2 string, "
    "position array<struct<pos:int,sent:string>>, label array<string>"
)


def answer_sentence(sentences: Column, start: Column, compat: bool = False) -> Column:
    """Sentence that holds the character at `start`; empty text if there is none.

    Default: a sentence spans [offset, offset + length) and the next one begins after the cut space. `compat` uses
    open intervals and a running offset that ignores the cut spaces.
    """
    gap = 0 if compat else 1

    def step(state: Column, sentence: Column) -> Column:
        low, high = state["offset"], state["offset"] + F.length(sentence)
        inside = ((start > low) if compat else (start >= low)) & (start < high)
        return F.struct((high + F.lit(gap)).alias("offset"),
                        F.when(inside, sentence).otherwise(state["found"]).alias("found"))

    return F.aggregate(sentences, F.struct(F.lit(0).alias("offset"), F.lit("").alias("found")), step,
                       lambda state: state["found"])


def flatten_questions(documents: DataFrame, compat: bool = False) -> DataFrame:
    """One row per question: `id, type, text1, text2, position, label`."""
    articles = documents.select(F.explode("data").alias("article"))
    paragraphs = articles.select(F.explode("article.paragraphs").alias("paragraph"))
    cut = paragraphs.select(F.col("paragraph.context").alias("text1"), F.explode("paragraph.qas").alias("qa"))
    answers = F.col("qa.answers")
    position = let(split_passage(F.col("text1")), lambda sentences: F.transform(
        answers, lambda a: F.struct(a["answer_start"].alias("pos"),
                                    answer_sentence(sentences, a["answer_start"], compat).alias("sent"))))
    return cut.select(F.col("qa.id").alias("id"), F.lit("mrc").alias("type"), "text1",
                      F.col("qa.question").alias("text2"), position.alias("position"),
                      F.transform(answers, lambda a: a["text"]).alias("label"))


def read_nested_questions(spark: SparkSession, paths, compat: bool = False, json_lines: bool = False) -> DataFrame:
    documents = spark.read.option("multiLine", not json_lines).schema(NESTED_SCHEMA).json(paths)
    return flatten_questions(documents, compat)


def shape_flat_questions(rows: DataFrame) -> DataFrame:
    """Context, question and the first answer."""
    return rows.select("id", F.col("text1").alias("context"), F.col("text2").alias("question"),
                       F.get("label", F.lit(0)).alias("label"))


def read_flat_questions(spark: SparkSession, paths) -> DataFrame:
    return shape_flat_questions(spark.read.schema(FLAT_SCHEMA).json(paths))
