"""The training-corpus pipeline: language ID, exact dedup, near dedup, secret redaction, packing.

Every stage reads what its predecessor kept and returns the columns of documents, but for the
last, which returns the pieces of packed sequences.  A document that no stage rejects ends up in
the packed sequences whole, with its secrets replaced by a mark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voltsheaf.llm.common import temporary, written
from voltsheaf.llm.exact_dedup import drop_copies
from voltsheaf.llm.langid import keep_identified
from voltsheaf.llm.near_dedup import drop_near_copies
from voltsheaf.llm.packing import pack
from voltsheaf.llm.secrets import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no learnt language, or without a letter, go."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the least doc_id stays."""
    return drop_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark; no document goes."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: The learnt language filters, signatures and packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each written as Parquet and read again.

    What a stage wrote on its way goes once its own output is written, and all but the last output
    once that is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporary(spark):
        for name, stage in STAGES[:-1]:
            with temporary(spark):
                docs = written(stage(spark, docs, sf_dir), name, outlast=True)
        name, stage = STAGES[-1]
        return written(stage(spark, docs, sf_dir), name, outlast=True)
