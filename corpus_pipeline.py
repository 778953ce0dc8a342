"""A training corpus from raw documents, in five stages that are each written and read again.

Toxic documents go, then those without a language, then exact copies, then near copies; what is left is
packed into sequences. Each stage works on all that its predecessor kept, and decides for each row: rows that
share an identifier, or have none, stand or go by their own texts. Stages but the last return the columns of
``documents``.

Defined cases: a null or empty text has no language and goes in the second stage; of texts that are equal but for
A-Z the largest identifier's row stays (a null one is the smallest, of several the first row), of near copies the
smallest identifier's (a null one is the largest); further columns, whatever their names, pass through; an empty
table gives no sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact_dedup, langid, near_dedup, packing, toxicity
from millrace.llm.common import written
from millrace.llm.queries import how_to_pack

#: A document stays if its language's share among its words is at least this, which also a text in two or three languages reaches.
LEAST_SHARE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_without_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.with_language(docs, langid.fit(docs), LEAST_SHARE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pieces(docs, how_to_pack())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language_id", drop_without_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: Classifiers and packing have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
