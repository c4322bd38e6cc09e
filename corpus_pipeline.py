"""From raw documents to a training mix: five stages, each over all rows of the one before.

Toxic documents go, later repeated runs are cut out of texts, one document of each
near-duplicate group stays, documents that overlap the benchmark go, and the sources
are mixed to their target weights. Every stage takes ``(spark, docs, sf_dir)`` and returns a
DataFrame; ``run`` writes each result as Parquet to the shared folder and reads it again for
the next. All stages but the last return the columns of ``documents``; the last adds
``mix_copy`` and has every document as often as the mix takes it.

Defined cases are those of the operators: rows with null texts pass all filters, take part
in no comparison and have no words to mix; an empty table stays empty; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import decontamination, line_dedup, mixing, near_dedup, toxicity
from kindred.llm.catalog import table, toxic_labels
from kindred.session import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects."""
    model = toxicity.fit(toxicity.labelled_sample(docs, toxic_labels(spark, sf_dir)))
    return toxicity.reject(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs are cut out; every document stays.

    Columns that are named like the operator's own are set aside meanwhile.
    """
    aside = {c: f"__aside_{c}" for c in line_dedup.ADDED if c in docs.columns}
    cleaned = line_dedup.remove(docs.withColumnsRenamed(aside)).drop(*line_dedup.ADDED)
    return cleaned.withColumnsRenamed({new: old for old, new in aside.items()}).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that overlap a benchmark item."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed_copies(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: Models and iterations cannot be stated in plain SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
