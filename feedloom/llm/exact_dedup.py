"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import seeded, whole_text, without_blanks
from feedloom.session import settle

#: Code points of the normal form that the prefix hash reads.
PREFIX = 256


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per row of `docs`: length, prefix hash and SHA-256 of the normal form.

    The normal form is the text without blanks. `row` numbers the rows, so that repeated ids stay
    apart; it is only stable once the table is written.
    """
    text = whole_text(text_col)
    normal = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.char_length(text).alias("n_chars"),
        without_blanks(text).alias("normal"),
    )
    return normal.select(
        "row",
        "id",
        "n_chars",
        F.octet_length("normal").alias("length"),
        seeded("prefix", F.substring("normal", 1, PREFIX)).alias("prefix"),
        F.sha2("normal", 256).alias("full"),
    )


def narrowed(prints: DataFrame) -> DataFrame:
    """The rows that share both length and prefix hash with another row.

    Rows alone at their length leave first, then, of the others, rows alone at their prefix hash.
    Each step is written, so that the next counts within its own tasks before it shuffles.
    """
    rows = prints
    for key in (["length"], ["length", "prefix"]):
        shared = rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key)
        rows = settle(rows.join(shared, key, "left_semi"), f"same_{key[-1]}")
    return rows


def equal_groups(prints: DataFrame) -> DataFrame:
    """Groups of two or more equal rows: length, prefix, full, group_size, keep.

    Full hashes are compared only among the rows that `narrowed` leaves. Rows are counted before
    they are shuffled, so a large group of copies is one row per task by then.
    """
    best = F.struct(
        (-F.col("n_chars")).alias("shorter"), F.col("id").isNull().alias("unknown"), "id", "row"
    )
    whole = narrowed(prints).groupBy("length", "prefix", "full").agg(
        F.count("*").alias("group_size"), F.min(best).alias("keep")
    )
    return whole.filter("group_size > 1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which row of each group of equal texts stays; one row for each row of `docs`.

    Texts are equal when their normal forms are; a null text counts as empty. The row with the
    most code points stays, then the smallest id (a null id comes last), then the first row.
    Returns id, keep_id, group_size, kept, full (SHA-256 of the normal form). Any other columns
    of `docs` are ignored; no rows give no rows.
    """
    prints = settle(fingerprints(docs, id_col, text_col), "fingerprints")
    key = ["length", "prefix", "full"]
    joined = prints.join(equal_groups(prints), key, "left")
    alone = F.col("keep").isNull()
    return joined.select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep.row"))).alias("kept"),
        "full",
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents."""
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.col("full").alias("text_sha256"),
    )


SQL_OP10 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
  text_sha256
FROM t
"""
