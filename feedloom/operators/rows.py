"""Set operations and row-level joins on items, posts and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.constants import (
    PLACEHOLDER_BULLET,
    PLACEHOLDER_SUMMARY,
    PLACEHOLDER_TITLES,
)
from feedloom.functions.text import is_blank


def union_feeds(parts: list[DataFrame]) -> DataFrame:
    """All items, repeats kept."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def placeholder_rows(feeds: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """One post for each feed without items; item feeds are made distinct before the join."""
    silent = feeds.join(items.select("feed_id").distinct(), "feed_id", "left_anti")
    note = F.array(F.lit(PLACEHOLDER_BULLET))
    return silent.select(
        "feed_id",
        "source_name",
        F.lit(PLACEHOLDER_TITLES[0]).alias("title"),
        F.lit(PLACEHOLDER_SUMMARY).alias("summary"),
        F.lit("").alias("link"),
        as_of.alias("published"),
        note.alias("english_summary"),
        note.alias("korean_summary"),
    )


def fallback_if_empty(first: DataFrame, second: DataFrame, by: str) -> DataFrame:
    """Rows of `first`; for groups it lacks, the rows of `second`."""
    lacking = second.join(first.select(by).distinct(), by, "left_anti")
    return first.unionByName(lacking)


def distinct_lines(rows: DataFrame, key: str, lines: Column) -> DataFrame:
    """The lines of each key that differ ignoring case, the first spelling kept.

    Lines are spread over tasks by key and line, so one long text is no single group.
    """
    exploded = rows.select(key, F.posexplode(lines).alias("pos", "line"))
    firsts = exploded.groupBy(key, F.lower("line").alias("_line")).agg(
        F.min(F.struct("pos", "line")).alias("f")
    )
    return firsts.select(key, "f.pos", "f.line")


def enrich_pages(posts: DataFrame, pages: DataFrame, on: str = "link") -> DataFrame:
    """Posts with the columns of their page, found by link without case; a blank link meets none.

    Blank links become keys of their own that no page has, so they do not gather in one task.
    """
    blank = is_blank(F.col(on))
    spare = F.concat(F.lit(" "), F.xxhash64(*posts.columns).cast("string"))
    keyed = posts.withColumn("_page_key", F.when(blank, spare).otherwise(F.lower(on)))
    found = pages.withColumnRenamed("url", "_page_key").filter(~is_blank(F.col("_page_key")))
    return keyed.join(found, "_page_key", "left").drop("_page_key")
