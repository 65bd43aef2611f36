"""The corpus pipeline: quality rules, near duplicates, decontamination, secrets, packing.

Each stage takes the documents that the one before kept, written as Parquet and read again, and
keeps all their columns, whatever their names; the last one returns packed pieces. An empty
table goes through all stages and gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmatch.llm import decontaminate, jaccard, packing, quality_rules, secrets
from lumenmatch.llm.common import materialize, small_batches, table
from lumenmatch.llm.queries import word_vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; boilerplate lines are cut from the others.

    Null and empty texts have too few words and go; rows that repeat an id and a text get one
    verdict; ids that repeat with other texts, and null ids, are judged by their text.
    """
    return _measured(quality_rules.clean_documents(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Texts without words stay; rows that repeat an id and a text stay once; a row with a null id
    goes if a document with an id is in its group.
    """
    return jaccard.keep_one(docs)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark windows are cut from the texts; all rows stay, also those left without words.

    Null texts and null or empty items have no windows; overlapping hits are cut once.
    """
    return _measured(decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, overlapping ones as one; all rows stay, null texts as they are."""
    return _measured(secrets.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 ids; null text is empty, repeated rows are packed each."""
    return packing.pack_documents(docs, word_vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", cut_benchmarks),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL has no expression for the trained and the packing stages; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with small_batches(spark):
                docs = materialize(docs)
    return docs
