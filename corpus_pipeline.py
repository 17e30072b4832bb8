"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's docs.

Every stage works on all rows that the one before it kept; all but the last return the columns of documents. Stages behave alike for odd rows: no column's null fails, extra
columns of any names are carried along by all but the last, empty tables give empty ones, and whole texts are read however long they are.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from huescope.llm import decontaminate, mixing, near_dedup, quality, queries, tokens
from huescope.llm.shared import collected, drop, table

_left: list[DataFrame] = []


def stage(function):
    """A stage that deletes the intermediate tables of the stages before it, unless docs still reads them (then docs wasn't written and read again)."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = tuple(docs.inputFiles()) if _left else ()
        gone = [t for t in _left if not any(t._own_table.removeprefix("file://") in f for f in read)]
        drop(*gone)
        _left[:] = [t for t in _left if all(t is not g for g in gone)]
        with collected() as made:
            out = function(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null text is an empty one, which is weighed like others; equal texts share their fate, but for the draw; repeated rows are rows of their own."""
    return quality.choose(docs, queries.read(spark, sf_dir, "labels"))


@stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (runs of five words, 0.8) stays: the least doc_id, null last, ties by the text's hash. Null, empty and wordless texts all stay; of repeated rows with words one stays."""
    return near_dedup.keep_one(docs)


@stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, repeated rows alike. Null and empty texts stay, null and empty items are found in nothing."""
    return decontaminate.without_leaks(docs, queries.read(spark, sf_dir, "benchmark"))


@stage
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; rows are the passages taken. A null source is a source of its own; null, empty and wordless texts give no rows; repeated rows are mixed each with its own columns."""
    return mixing.mix_documents(docs)


@stage
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as token ids, written and read back: a row each, in doc_id order, null first, ties by text. A null text is an empty one: its end id alone."""
    return tokens.token_digests(docs, queries.tokenizer_path())


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("mixing", mix_stage), ("tokens", token_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
