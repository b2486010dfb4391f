"""Line dedup: lines that many documents share lose all their copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import BLANKS, LOWER, UPPER, seeded, wrapped

#: Production parameters.
MIN_DOCUMENTS = 10
MIN_CHARS = 1

#: Only characters whose lower case is known to be themselves, besides ASCII.
_PLAIN = r"^[\x00-\x7Fß-öø-ÿ]*$"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case.

    `lower` is quick and gives the same where no other capital can occur.
    """
    trimmed = F.btrim(line, F.lit(BLANKS))
    return F.when(trimmed.rlike(_PLAIN), F.lower(trimmed)).otherwise(
        F.translate(trimmed, UPPER, LOWER)
    )


def lines_of(text: Column) -> Column:
    """The lines of a text; null or empty is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(key: Column) -> list[Column]:
    """128 bits, so that no two different lines are taken for one."""
    return [seeded("line", key).alias("h1"), seeded("again", key).alias("h2")]


def common_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCUMENTS,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """Hashes (h1, h2) of the keys found in at least `min_docs` documents.

    A key counts once per id, however many rows of `docs` have that id and however often they repeat
    the key; each row with a null id is a document of its own. Counts are summed in each task
    before the shuffle.
    """
    id_ = F.col(f"`{id_col}`")
    keys = F.array_distinct(F.transform(lines_of(F.col(f"`{text_col}`")), line_key))
    named = docs.select(
        id_.alias("id"), F.when(id_.isNull(), F.monotonically_increasing_id()).alias("row"), keys.alias("keys")
    )
    each = named.select("id", "row", F.explode("keys").alias("key")).filter(F.char_length("key") >= min_chars)
    once = each.select(*_hashes(F.col("key")), "id", "row").distinct()
    counted = once.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_docs).select("h1", "h2")


def drop_common_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCUMENTS,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """`docs` with `text_col` cleaned, and two more columns, n_lines and n_dropped.

    Keys of at least `min_chars` code points that occur in at least `min_docs` documents lose all
    their lines; the others stay in their order. A null or empty text is one empty line and
    becomes ''. Rows are found again by a hash of id and text: whether a line goes depends on
    the line alone, so rows that share a hash cannot harm each other, and null or repeated ids
    need no special case. Column names n_lines and n_dropped of `docs` are replaced.
    """
    common = common_lines(docs, id_col, text_col, min_docs, min_chars)

    def place(id_: Column, text: Column) -> Column:
        return seeded("row", id_, text)

    text = F.col(f"`{text_col}`")
    keys = F.transform(lines_of(text), line_key)
    each = (
        docs.select(place(F.col(f"`{id_col}`"), text).alias("place"), F.posexplode(keys).alias("pos", "key"))
        .filter(F.char_length("key") >= min_chars)
        .select("place", "pos", *_hashes(F.col("key")))
    )
    lost = (
        each.join(common, ["h1", "h2"], "left_semi")
        .groupBy(F.col("place").alias("_place"))
        .agg(F.collect_set("pos").alias("_lost"))
    )
    kept_columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    doc = F.col("_doc")
    base = wrapped(docs).withColumn("_row", place(doc[id_col], doc[text_col]))
    joined = base.join(lost, F.col("_row") == F.col("_place"), "left")
    lines = joined.withColumn("_lines", lines_of(doc[text_col]))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost"))
    cleaned = F.when(F.col("_lost").isNull(), F.coalesce(doc[text_col], F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    )
    return lines.select(
        *[(cleaned if c == text_col else doc[c]).alias(c) for c in kept_columns],
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("_lost").isNull(), F.lit(0)).otherwise(F.size("_lost")).cast("long").alias("n_dropped"),
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Line dedup of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_common_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


SQL_OP8 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
    translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
