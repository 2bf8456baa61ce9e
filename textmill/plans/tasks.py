"""Named tasks: preparation, formatting and gold labels, and the assembly of train, validation and test rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..operators import formatting as fmt
from ..operators.dataset import (filter_by_length, rebalance, reduce_answers, shard_sample, train_test_split)
from ..operators.tokens import encode_pairs
from ..sources.pairs import concat_sources

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Task:
    """`shape` prepares any row, `augment` changes the training rows of a split frame, `format` gives both texts.

    `drops_long`: without truncation, rows over the length limit are dropped rather than cut.
    """

    format: Callable[..., DataFrame]
    gold_labels: dict[str, int] | None = None
    shape: Step | None = None
    augment: Step | None = None
    valid_proportion: float = 0.0
    valid_is_test: bool = False
    drops_long: bool = False
    seeds: tuple[int, int] = (fv.TEXT_TEST_SEED, fv.TEXT_VALID_SEED)


def _ids(targets: dict[int, str]) -> dict[str, int]:
    return {text: i for i, text in targets.items()}


def _nli_gold(classes: list[str]) -> dict[str, int]:
    return {fv.NLI_TARGETS[name]: i for i, name in enumerate(classes)}


def _kornli(df: DataFrame) -> DataFrame:
    return fmt.format_nli(df, classes=fv.KORNLI_CLASSES)


def _sentiment_prompted(df: DataFrame) -> DataFrame:
    return fmt.format_template(df, "document", "label", fv.SENTIMENT_INPUT, fv.LABEL_ONLY, fv.SENTIMENT_TARGETS)


_TRAIN = "split = 'train'"


def _half_sample(df: DataFrame) -> DataFrame:
    return shard_sample(df, 2, fv.CLASSIFIER_SAMPLE_SEED, only=F.expr(_TRAIN))


def _rebalanced(df: DataFrame) -> DataFrame:
    return rebalance(df, only=F.expr(_TRAIN))


def _multitask(df: DataFrame, label_map) -> DataFrame:
    return fmt.format_template(df, "title", "label", fv.MULTITASK_INPUT, fv.LABEL_ONLY, label_map)


_CLASSIFIER_SEEDS = (fv.CLASSIFIER_SPLIT_SEED, fv.CLASSIFIER_SPLIT_SEED)
_JSON_SEEDS = (fv.JSON_TEST_SEED, fv.JSON_VALID_SEED)

TASKS: dict[str, Task] = {
    "nsmc-naive": Task(lambda df: fmt.format_plain(df, "document", "label", fv.SENTIMENT_TARGETS),
                       _ids(fv.SENTIMENT_TARGETS), valid_proportion=0.02),
    "nsmc-prompted": Task(_sentiment_prompted, _ids(fv.SENTIMENT_TARGETS), valid_proportion=0.02),
    "klue-nli": Task(fmt.format_nli, _nli_gold(fv.NLI_CLASSES), valid_is_test=True),
    "klue-ynat": Task(fmt.format_topic, _ids(fv.TOPIC_TARGETS), valid_proportion=0.01),
    "kornli-prompted": Task(_kornli, _nli_gold(fv.KORNLI_CLASSES)),
    "paws-x-kor": Task(fmt.format_paraphrase, _ids(fv.PARAPHRASE_TARGETS)),
    "kr-internal": Task(fmt.format_title_content, augment=_half_sample, valid_proportion=0.05,
                        seeds=_CLASSIFIER_SEEDS),
    "kr-internal-mtl": Task(_multitask, augment=_half_sample, valid_proportion=0.05, seeds=_CLASSIFIER_SEEDS),
    "klue-mrc": Task(fmt.format_mrc, shape=reduce_answers, augment=_rebalanced, valid_is_test=True),
    "klue-ner": Task(fmt.format_ner, valid_is_test=True),
    "klue-dp": Task(fmt.format_dependency, shape=fmt.build_dependency_strings, valid_is_test=True),
    "korquad-v1": Task(fmt.format_qa, valid_proportion=0.05),
    "hfdataset": Task(lambda df: fmt.format_plain(df, "text", "label"), drops_long=True),
    "jsonlines": Task(lambda df: fmt.format_plain(df, "text", "label"), drops_long=True, seeds=_JSON_SEEDS),
}
DEFAULT_TASK = Task(lambda df: fmt.format_plain(df, "text", "target_text"), drops_long=True)
# Tasks whose class names come with the data: the caller passes them as an id-to-name dict.
_NEEDS_LABEL_MAP = ("kr-internal", "kr-internal-mtl")


def get_task(name: str) -> Task:
    """Any other name is the delimited pair task."""
    return TASKS.get(name, DEFAULT_TASK)


def format_task(name: str, df: DataFrame, label_map=None) -> DataFrame:
    """`row_id, split, input_text, target_text` of the named task."""
    task = get_task(name)
    shaped = df.transform(task.shape) if task.shape else df
    if name in _NEEDS_LABEL_MAP:
        return task.format(shaped, label_map=label_map)
    return shaped.transform(task.format)


def assemble_splits(name: str, train: DataFrame | list[DataFrame] | None, valid=None, test=None,
                    valid_proportion: float | None = None, test_proportion: float = 0.0) -> DataFrame:
    """All rows with a `split` column. A proportion only counts where no rows are given for that split.

    Without training rows, a test-only run keeps the rows it has.
    """
    task = get_task(name)
    share = task.valid_proportion if valid_proportion is None else valid_proportion

    def one(rows):
        return concat_sources(rows) if isinstance(rows, list) else rows

    train, valid, test = one(train), one(valid), one(test)
    if valid is None and test is not None and task.valid_is_test:
        valid = test
    parts = []
    if train is not None:
        split = train_test_split(train, 0.0 if test is not None else test_proportion,
                                 0.0 if valid is not None else share, task.seeds)
        parts.append(split.transform(task.augment) if task.augment else split)
    for rows, label in ((valid, "validation"), (test, "test")):
        if rows is not None:
            parts.append(rows.withColumn("split", F.lit(label)))
    if not parts:
        raise ValueError("no rows given")
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


def prepare(name: str, train=None, valid=None, test=None, valid_proportion: float | None = None,
            test_proportion: float = 0.0, max_len: int | None = None, truncate: bool = False,
            label_map=None, encode: bool = True) -> DataFrame:
    """Read rows to encoded examples: split, format, filter by length, encode. One lazy plan without a shuffle.

    Rows that are not dropped, such as long test rows, are cut to `max_len` when they are encoded.
    """
    rows = assemble_splits(name, train, valid, test, valid_proportion, test_proportion)
    formatted = format_task(name, rows, label_map)
    keep_long = truncate or not get_task(name).drops_long
    kept = filter_by_length(formatted, max_len, ["input_text", "target_text"], truncate=keep_long)
    return encode_pairs(kept, max_len) if encode else kept
