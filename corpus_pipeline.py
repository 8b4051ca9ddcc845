"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
stage's docs. All but the last return the columns of `documents`. A stage first deletes what the stages before it have
stored for themselves, since their results are written by then; tables of other queries in the session stay.

Stages without SQL: a fitted model, an edit join, components of a similarity graph, fingerprints, and bin completion
aren't expressible over whole tables in SQL; so ORACLE_SQL is None, and tests hold the pipeline against a plain
re-statement of its stages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sparkomics.llm.common import owned, release, stored, table
from sparkomics.llm.decontamination import clean
from sparkomics.llm.line_dedup import deduplicated
from sparkomics.llm.ngram_join import one_of_each
from sparkomics.llm.packing import best_fit_packing
from sparkomics.llm.queries import tokenizer_path
from sparkomics.llm.toxicity import keep_clean


OWNER = "pipeline"


def stage(build: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The function, owning what it stores."""

    @wraps(build)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, OWNER)
        with owned(OWNER):
            return build(spark, docs, sf_dir)

    return run_stage


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model trained on `labels` rejects go."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat or nearly repeat an earlier one go, and documents that were nothing else."""
    return deduplicated(docs)


@stage
def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what stays, and their places in sequences."""
    return best_fit_packing(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, build in STAGES[:-1]:
        docs = stored(build(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
