"""The corpus pipeline: documents in, token ids out, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is written and read
again before the next. All but the last return the columns of documents.

Defined results: documents whose text is null or has no letter go in the first stage. A null doc_id is a document like any
other: its lines and its benchmark items are judged by its text, and it is never a near duplicate; rows that repeat a doc_id
are one document to the duplicate stages, of which one row stays. Empty tables give empty tables. Other columns pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import bpe, contamination, jaccard_join, lang_id, line_dedup
from tracelake.llm._common import cut, table


#: Rows that go to a Python worker at once: texts may be long, and five stages share an executor's memory.
ARROW_ROWS = 1_000


def configured(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, in a session that sends ARROW_ROWS rows at a time."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@configured
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay."""
    return lang_id.keep_identified(docs)


@configured
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go; a document of nothing but such lines goes with them."""
    return line_dedup.keep_unrepeated(docs)


@configured
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five words, 0.8), the document of the smallest id stays."""
    return jaccard_join.keep_one(docs)


@configured
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain four fifths of a benchmark item's shingles go."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@configured
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text that is left, with a check of the round trip."""
    return bpe.encoded(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]

#: The learned language model has no SQL form; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
