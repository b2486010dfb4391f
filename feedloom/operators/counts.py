"""Counts over long sliding windows, without pairing each item with each run.

Items are summed per feed and second before anything else, so a busy feed is a few rows per
second however many items it has. A count is then a difference of running totals, or a running
total of "appears" and "is too old" where copies of a link count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.dates import ago
from feedloom.operators.filters import nonblank_link

#: Parts that the links of a feed group are dealt in when they meet its window lengths.
SALTS = 64


def totals_at(asked: DataFrame, changes: DataFrame, by: list[str]) -> DataFrame:
    """The running total of `changes` per `by` columns at each asked mark.

    `asked`: digest_id, the `by` columns, `mark` (a name), `at` and `strict` (changes at `at`
    itself do not count). `changes`: the `by` columns, `at` and `change`. Changes, summed per moment, and marks are
    one line of rows. It is swept twice: within each hour, then over the sums of the hours, which are few.
    """
    keys = ["digest_id", "mark", *by]
    slot = F.date_trunc("hour", "at").alias("slot")
    summed = changes.groupBy(*by, slot, "at").agg(F.sum("change").alias("change"))
    # At one moment: strict marks, changes, other marks.
    marks = asked.select(*keys, "at", slot, F.when(F.col("strict"), 0).otherwise(2).alias("_order"))
    line = summed.withColumn("_order", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    hour = Window.partitionBy(*by, "slot").orderBy("at", "_order")
    so_far = hour.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = line.withColumns(
        {"within": F.coalesce(F.sum("change").over(so_far), F.lit(0)), "_last": F.lead(F.lit(True), 1, False).over(hour)}
    )
    # The last row of an hour has the sum of the hour.
    few = swept.filter("_order <> 1 OR NOT _last").withColumn("_hour", F.when(~F.col("_last"), F.col("within")))
    earlier = Window.partitionBy(*by).orderBy("_second").rangeBetween(Window.unboundedPreceding, -1)
    placed = few.withColumn("_second", F.unix_timestamp("slot")).withColumn("before", F.sum("_hour").over(earlier))
    return placed.filter("_order <> 1").select(*keys, (F.col("within") + F.coalesce("before", F.lit(0))).alias("n"))


def feed_counts(asked: DataFrame, items: DataFrame, hours: dict[str, str]) -> DataFrame:
    """Items per run and feed from `as_of` back to some hours before it, both ends included.

    `asked`: digest_id, feed_group, feed_id, as_of and the hour columns, one row per run and feed.
    `hours` maps each result column to its hour column. A count is the total at `as_of` less the
    total before the window began.
    """
    by = ["feed_group", "feed_id"]
    seen = items.filter("published IS NOT NULL").select(
        *by, F.col("published").alias("at"), F.lit(1).alias("change")
    )
    ends = [
        F.struct(F.lit("upto").alias("mark"), F.col("as_of").alias("at"), F.lit(False).alias("strict")),
        *[
            F.struct(
                F.lit(name).alias("mark"), ago(F.col("as_of"), hours=F.col(h)).alias("at"), F.lit(True).alias("strict")
            )
            for name, h in hours.items()
        ],
    ]
    marks = asked.select("digest_id", *by, F.explode(F.array(*ends)).alias("e")).select("digest_id", *by, "e.*")
    totals = totals_at(marks, seen, by)

    def at(mark: str) -> Column:
        return F.max(F.when(F.col("mark") == mark, F.col("n")))

    return totals.groupBy("digest_id", "feed_id").agg(
        *[(at("upto") - at(name)).alias(name) for name in hours]
    )


def links_per_run(runs: DataFrame, items: DataFrame) -> DataFrame:
    """How many links, ignoring case, each run finds within its `days_since` days, both ends included.

    Copies of a link within one hour form a block from its first to its last time. A block
    counts from its first time, or from the end of the block before if that still covers it,
    so that overlapping blocks of one link count once. A link has one row per hour at most.
    """
    asked = runs.select(
        "digest_id", "feed_group", "as_of", (F.col("days_since") * 24).alias("hours")
    )
    blocks = (
        nonblank_link(items)
        .groupBy("feed_group", F.upper("link").alias("link"), F.date_trunc("hour", "published"))
        .agg(F.min("published").alias("first"), F.max("published").alias("last"))
        .filter(F.col("last").isNotNull())
    )
    by = ["feed_group", "hours"]
    salt = F.pmod(F.xxhash64("link"), F.lit(SALTS)).cast("int")
    lengths = asked.select(*by).distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spans = blocks.withColumn("_salt", salt).join(lengths, ["feed_group", "_salt"]).drop("_salt")
    # A link is out of a window that began after it: one microsecond past its last time in it.
    gone = F.col("last") + F.make_dt_interval(hours=F.col("hours")) + F.expr("INTERVAL 1 MICROSECOND")
    earlier = F.lag("gone").over(Window.partitionBy(*by, "link").orderBy("first"))
    timed = spans.withColumn("gone", gone).withColumn("begin", F.greatest(F.col("first"), earlier))
    both = F.array(
        F.struct(F.col("begin").alias("at"), F.lit(1).alias("change")),
        F.struct(F.col("gone").alias("at"), F.lit(-1).alias("change")),
    )
    changes = timed.select(*by, F.explode(both).alias("c")).select(*by, "c.at", "c.change")
    marks = asked.select("digest_id", *by, F.lit("at").alias("mark"), F.col("as_of").alias("at"), F.lit(False).alias("strict"))
    counted = totals_at(marks, changes, by)
    return counted.select("digest_id", F.col("n").alias("all_items"))
