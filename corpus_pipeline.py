"""The corpus pipeline: from raw documents to packed training sequences.

Stages run in the order of `STAGES`. Each takes all rows that the stage before it kept, writes Parquet to
the shared folder, and the next one reads that. All but the last return the columns of `documents`.
A null in any column, empty and very long texts, ties, repeated rows and empty tables are handled as
the operators' docstrings say; columns beyond those of `documents` pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import unwrapped, wrapped
from feedloom.llm.line_dedup import drop_common_lines
from feedloom.llm.near_dedup import drop_near_duplicates
from feedloom.llm.packing import byte_tokens, pack
from feedloom.llm.pii import mask_personal
from feedloom.llm.quality import THRESHOLD, score, train
from feedloom.session import settle


def _with_size(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`columns`, with n_chars counted anew where the documents carry it."""

    def value(c: str) -> Column:
        if c == "n_chars":
            return F.when(F.col("text").isNull(), F.col(c)).otherwise(F.char_length("text").cast("long")).alias(c)
        return F.col(f"`{c}`")

    return docs.select(*[value(c) for c in columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = wrapped(docs).withColumn("text", F.col("_doc")["text"])
    good = score(rows, train(docs, labels)).filter(F.col("score") >= THRESHOLD)
    return unwrapped(good, docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; a document of such lines only stays, empty."""
    return _with_size(drop_common_lines(docs), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return _with_size(mask_personal(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all byte tokens in sequences: doc_id, run, start, length, bin, offset, capacity, fill."""
    return pack(docs, byte_tokens()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_shared_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("pii", mask_private),
    ("best_fit_packing", pack_sequences),
]

#: The classifier and the near-duplicates have no SQL form; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
