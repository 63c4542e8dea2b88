"""From raw documents to packed bins: five stages, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. Stages are written as Parquet and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesto.llm._common import cleared, table, written
from attesto.llm.langid import held_out, learn, recognised
from attesto.llm.mixing import mixed, repeated, weight_table
from attesto.llm.near_dedup import deduplicated
from attesto.llm.packing import bins, packed
from attesto.llm.secrets import redacted

#: Similarity of word shingles, in hundredths, from which documents are near copies.
PERCENT = 80
#: Part of all tokens that the mix asks for, and epochs of a source at most.
SHARE, EPOCHS = 0.8, 2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised (und: null texts and those without a letter) go; a null lang is filled, a given one kept."""
    return recognised(docs, learn(docs.where(~held_out())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id."""
    return deduplicated(docs, percent=PERCENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a placeholder; all documents stay."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the budgets that mixing.WEIGHTS give their domain, language and source: some go, some repeat, one a source is cut."""
    return repeated(mixed(docs, share=SHARE, max_epochs=EPOCHS, weights=weight_table(spark)), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each bin: shard, bin, capacity, used and what it holds in order, as doc_ids, starts and lengths."""
    return bins(packed(docs))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
    ("packing", packing),
]

#: No SQL expresses the trained network or the packing; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with cleared(keep=1):  # what a stage wrote for itself goes when its result is written
            docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
