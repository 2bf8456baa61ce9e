"""Readers of the language-understanding benchmark files."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv
from ..functions.text import strip
from ..operators.dialogue import dialogue_examples
from ..operators.labels import encode_class
from .lines import with_file_row_number

_ENTITY = "struct<word:string,start_idx:int,end_idx:int>"
_LABELS = "struct<label:float,`real-label`:float,`binary-label`:int>"
RECORD_SCHEMAS = {
    "re": f"sentence string, subject_entity {_ENTITY}, object_entity {_ENTITY}, label string",
    "ynat": "title string, label string",
    "ynat-aeda": "title string, label string",
    "nli": "premise string, hypothesis string, gold_label string",
    "sts": f"sentence1 string, sentence2 string, labels {_LABELS}",
    "wos": "domains array<string>, dialogue array<struct<role:string,text:string,state:array<string>>>",
}
_ANSWERS = "array<struct<text:string,answer_start:int>>"
READING_SCHEMA = (
    "data array<struct<title:string, paragraphs:array<struct<context:string, qas:array<struct<"
    f"id:string, guid:string, question:string, answers:{_ANSWERS}, plausible_answers:{_ANSWERS}>>>>>>"
)
BENCHMARK_FILES = {
    "re": "klue-re-v1.1", "ynat": "ynat-v1.1", "nli": "klue-nli-v1.1", "sts": "klue-sts-v1.1",
    "mrc": "klue-mrc-v1.1", "ner": "klue-ner-v1.1", "dp": "klue-dp-v1.1", "dp_hfstyle": "klue-dp-v1.1",
    "wos": "wos-v1.1",
}


def benchmark_files(config: str, folder: str) -> dict[str, str]:
    """Split name to file path. The published development file is the test split."""
    if config == "ynat-aeda":
        return {"train": f"{folder}/ynat-v1.1/ynat-v1.1_train_aeda_0.7augmented.json"}
    name = BENCHMARK_FILES[config]
    suffix = "tsv" if config in ("ner", "dp", "dp_hfstyle") else "json"
    return {"train": f"{folder}/{name}/{name}_train.{suffix}", "test": f"{folder}/{name}/{name}_dev.{suffix}"}


def read_benchmark(spark: SparkSession, config: str, folder: str, relations: list[str] | None = None) -> DataFrame:
    """All splits of one benchmark configuration with a `split` column.

    The relations of `re` are read from `relation_list.json` beside its files unless they are given.
    """
    if config == "re" and relations is None:
        relations = read_class_names(spark, f"{folder}/{BENCHMARK_FILES[config]}/relation_list.json", config)
    readers = {"mrc": read_reading_questions, "wos": read_dialogue_states, "ner": read_ner_blocks,
               "dp": read_dependency_blocks, "dp_hfstyle": read_dependency_sentences}
    frames = []
    for split, path in benchmark_files(config, folder).items():
        if config in readers:
            frame = readers[config](spark, path)
        else:
            frame = read_benchmark_json(spark, config, path, relations=relations)
        frames.append(frame.withColumn("split", F.lit(split)))
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def _json_records(spark: SparkSession, paths, schema: str, json_lines: bool) -> DataFrame:
    # One array file is one task; JSON lines are splittable, and the better layout for large inputs.
    rows = spark.read.option("multiLine", not json_lines).schema(schema).json(paths)
    numbered = with_file_row_number(rows.select("*", "_metadata"))
    return numbered.withColumnRenamed("line_no", "record_no").drop("_metadata", "row_id")


def read_benchmark_json(spark: SparkSession, config: str, paths, relations: list[str] | None = None,
                        json_lines: bool = False) -> DataFrame:
    """Sentence classification and pair records, renamed and class-encoded, keyed by `file_path, record_no`."""
    rows = _json_records(spark, paths, RECORD_SCHEMAS[config], json_lines)
    return shape_benchmark_records(rows, config, relations)


def shape_benchmark_records(rows: DataFrame, config: str, relations: list[str] | None = None) -> DataFrame:
    def entity(name: str, out: str) -> Column:
        value = F.col(name)
        return F.struct(value["word"].alias("text"), value["start_idx"].alias("start"),
                        value["end_idx"].alias("end")).alias(out)

    key = [c for c in ("file_path", "record_no") if c in rows.columns]
    if config == "re":
        shaped = rows.select(*key, "sentence", entity("subject_entity", "subject"),
                             entity("object_entity", "object"), "label")
        return encode_class(shaped, "label", relations) if relations else shaped
    if config in ("ynat", "ynat-aeda"):
        return encode_class(rows.select(*key, "title", "label"), "label", fv.TOPIC_CLASSES)
    if config == "nli":
        shaped = rows.select(*key, "premise", "hypothesis", F.col("gold_label").alias("label"))
        return encode_class(shaped, "label", fv.NLI_CLASSES)
    if config == "sts":
        labels = F.struct(F.col("labels.label").alias("label"), F.col("labels.`real-label`").alias("real_label"),
                          F.col("labels.`binary-label`").alias("binary_label"))
        return rows.select(*key, "sentence1", "sentence2", labels.alias("labels"))
    raise ValueError(f"unknown configuration {config!r}")


def flatten_reading_questions(documents: DataFrame) -> DataFrame:
    """One row per question of nested `data`; without answers the plausible ones are used and flagged."""
    keys = [c for c in ("file_path", "record_no") if c in documents.columns]
    articles = documents.select(*keys, F.posexplode("data").alias("article_no", "article"))
    paragraphs = articles.select(
        *keys, "article_no", F.col("article.title").alias("title"),
        F.posexplode("article.paragraphs").alias("paragraph_no", "paragraph"))
    questions = paragraphs.select(
        *keys, "article_no", "paragraph_no", "title", F.col("paragraph.context").alias("context"),
        F.posexplode("paragraph.qas").alias("question_no", "qa"))
    answers, plausible = F.col("qa.answers"), F.col("qa.plausible_answers")
    answered = F.coalesce(F.size(answers) > 0, F.lit(False))
    chosen = F.when(answered, answers).otherwise(F.coalesce(plausible, F.array().cast(_ANSWERS)))
    pairs = F.transform(chosen, lambda a: F.struct(a["text"].alias("text"), a["answer_start"].alias("start_idx")))
    return questions.select(
        *keys, "article_no", "paragraph_no", "question_no", "title", "context",
        F.col("qa.question").alias("question"),
        F.coalesce(F.col("qa.guid"), F.col("qa.id")).alias("qid"),
        (~answered & plausible.isNotNull()).alias("plausible_answer"),
        pairs.alias("answers"),
    )


def read_reading_questions(spark: SparkSession, paths, json_lines: bool = False) -> DataFrame:
    rows = spark.read.option("multiLine", not json_lines).schema(READING_SCHEMA).json(paths)
    numbered = with_file_row_number(rows.select("*", "_metadata")).withColumnRenamed("line_no", "record_no")
    return flatten_reading_questions(numbered)


def read_dialogue_states(spark: SparkSession, paths, json_lines: bool = False) -> DataFrame:
    """System turns of dialogue-state records, with history and states."""
    return dialogue_examples(_json_records(spark, paths, RECORD_SCHEMAS["wos"], json_lines))


def line_ending(spark: SparkSession, paths) -> str:
    """The line ending of the first line of the files."""
    first = spark.read.option("lineSep", "\n").text(paths).first()
    return "\r\n" if first is not None and first["value"].endswith("\r") else "\n"


def _blocks(spark: SparkSession, paths, newline: str | None = None) -> DataFrame:
    """One row per blank-line separated block, splittable inside a file.

    `newline` is the files' line ending, found from the first line if not given; a block with another one fails the job.
    """
    newline = newline or line_ending(spark, paths)
    other = "\n\n" if newline == "\r\n" else "\r\n\r\n"
    blocks = spark.read.option("lineSep", newline * 2).text(paths).select("value", "_metadata")
    numbered = with_file_row_number(blocks).withColumnRenamed("line_no", "block_no")
    mixed = F.raise_error(F.concat(F.lit("two line endings in "), "file_path"))
    checked = F.when(F.contains("value", F.lit(other)), mixed).otherwise(F.col("value"))
    return numbered.withColumn("lines", F.split(F.regexp_replace(checked, "^[\r\n]+|[\r\n]+$", ""), newline)).drop("value")


def ner_fields(lines: Column) -> Column:
    """Tab fields of the character lines of a tagging block."""
    body = F.filter(lines, lambda line: ~line.startswith("##") & (strip(line) != ""))
    return F.transform(body, lambda line: F.split(strip(line), "\t", -1))


def ner_block_columns(lines: Column, fields: Column) -> dict[str, Column]:
    """Characters, tags and tagged sentence of a tagging block. A line that holds only a tag stands for a space."""
    head = F.get(F.filter(lines, lambda line: line.startswith("## klue-ner")), F.lit(0))
    return {
        "sentence": F.transform(fields, lambda f: F.when(F.size(f) == 2, f[0]).otherwise("")),
        "tags": F.transform(fields, lambda f: F.when(F.size(f) == 2, F.get(f, F.lit(1))).otherwise(f[0])),
        "tagged_sent": strip(F.substr(head, F.instr(head, "\t") + 1)),
    }


def read_ner_blocks(spark: SparkSession, paths, newline: str | None = None) -> DataFrame:
    """`sentence` characters, `labels` class ids and `tagged_sent` per block. An unknown tag fails the job."""
    classes = F.array(*[F.lit(name) for name in fv.NER_CLASSES])
    # Blocks without any character line, such as file headings, are dropped by a test that stops at the first one.
    some = F.exists("lines", lambda line: ~line.startswith("##") & (strip(line) != ""))
    blocks = _blocks(spark, paths, newline).filter(some).withColumn("fields", ner_fields(F.col("lines")))
    shaped = blocks.withColumns(ner_block_columns(F.col("lines"), F.col("fields")))
    unknown = lambda tag: F.raise_error(F.concat(F.lit("unknown tag: "), tag))
    labels = F.transform("tags", lambda tag: F.when(F.array_contains(classes, tag), F.array_position(classes, tag) - 1)
                         .otherwise(unknown(tag)).cast("int"))
    return shaped.select("file_path", "block_no", "sentence", labels.alias("labels"), "tagged_sent")


def dependency_block_columns(lines: Column) -> dict[str, Column]:
    """Six parallel arrays from the six-field lines of a parse block, and the sentence of its heading."""
    heads = F.filter(lines, lambda line: line.startswith("##") & (F.instr(line, "\t") > 0))
    fields = F.filter(
        F.transform(F.filter(lines, lambda line: ~line.startswith("##")), lambda line: F.split(strip(line), "\t", -1)),
        lambda f: F.size(f) == 6,
    )

    def field(position: int, kind: str = "string") -> Column:
        return F.transform(fields, lambda f: f[position].try_cast(kind))

    return {
        "sentence": F.get(F.split(F.get(heads, F.lit(-1) + F.size(heads)), "\t", -1), F.lit(1)),
        "ids": field(0, "int"), "words": field(1), "lemma": field(2), "pos": field(3),
        "head": field(4, "int"), "relation": field(5),
    }


def read_dependency_blocks(spark: SparkSession, paths, newline: str | None = None) -> DataFrame:
    """`ids, words, lemma, pos, head, relation` per block."""
    columns = dependency_block_columns(F.col("lines"))
    blocks = _blocks(spark, paths, newline).withColumns(columns)
    return blocks.filter(F.size("ids") > 0).select(
        "file_path", "block_no", "ids", "words", "lemma", "pos", "head", "relation")


def read_dependency_sentences(spark: SparkSession, paths, newline: str | None = None) -> DataFrame:
    """The same blocks with their sentence; a last block without a closing blank line is kept."""
    columns = dependency_block_columns(F.col("lines"))
    blocks = _blocks(spark, paths, newline).withColumns(columns)
    return blocks.filter((F.size("ids") > 0) & F.col("sentence").isNotNull()).select(
        "file_path", "block_no", "sentence", F.col("ids").alias("index"), F.col("words").alias("word_form"),
        "lemma", "pos", "head", F.col("relation").alias("deprel"))


def read_nli_table(spark: SparkSession, paths) -> DataFrame:
    """Tab-separated inference pairs with a header; any row with a missing cell is dropped."""
    rows = spark.read.csv(paths, sep="\t", header=True, quote="", schema=None, inferSchema=False)
    kept = rows.select(F.col("sentence1").alias("premise"), F.col("sentence2").alias("hypothesis"),
                       F.col("gold_label").alias("label")).dropna()
    return encode_class(kept, "label", fv.KORNLI_CLASSES)


def read_sts_table(spark: SparkSession, paths) -> DataFrame:
    """Tab-separated similarity pairs with a header and seven columns; genre, file name and year become class ids."""
    rows = spark.read.csv(paths, sep="\t", header=True, quote="", inferSchema=False)
    shaped = rows.select("genre", "filename", "year", F.col("id").cast("int").alias("id"),
                         F.col("score").cast("float").alias("score"), "sentence1", "sentence2")
    for column, names in (("genre", fv.STS_GENRES), ("filename", fv.STS_FILES), ("year", fv.STS_YEARS)):
        shaped = encode_class(shaped, column, names)
    return shaped


def read_table_splits(spark: SparkSession, config: str, files: dict[str, object]) -> DataFrame:
    """The split files of a tab-table benchmark, `nli` or `sts`, as one table with a `split` column.

    `files` maps split names (train, validation, test) to paths.
    """
    read = {"nli": read_nli_table, "sts": read_sts_table}[config]
    frames = [read(spark, path).withColumn("split", F.lit(split)) for split, path in files.items()]
    return reduce(DataFrame.unionByName, frames)


def read_class_names(spark: SparkSession, path, config: str) -> list[str]:
    """Class names, in id order, from the table beside a benchmark: `relation_list.json` for `re`, `ontology.json` for `wos`.

    A relation list holds them under `relations`; an ontology's are its keys in file order.
    """
    text = spark.read.text(path, wholetext=True).first()["value"]
    table = json.loads(text)
    if config == "re":
        return list(table["relations"])
    if config == "wos":
        return list(table)
    raise ValueError(f"no class table for {config!r}")
