"""Dedup, state lookups, choice of posts per digest.

Every "first of a group" is a row number with a bound, which Spark also applies before the
shuffle, so a link or digest that holds a third of all rows sends few rows to its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.dates import ago
from feedloom.functions.keys import partition_key, row_key
from feedloom.operators.filters import nonblank_link

def item_key(items: DataFrame) -> list[str]:
    """What tells items apart: feed and place in the payload, and which payload where that is known."""
    return [c for c in ("feed_id", "fetched_at", "item_pos") if c in items.columns]


def _newest(posts: DataFrame) -> list:
    fetched = [F.col(c) for c in ("fetched_at",) if c in posts.columns]
    return [F.col("published").desc_nulls_last(), F.col("feed_pos"), *fetched, F.col("item_pos")]


def with_keys(posts: DataFrame) -> DataFrame:
    return posts.withColumns(
        {"pk": partition_key(F.col("source_name")), "rk": row_key(F.col("link"))}
    )


def dedup_by_link(posts: DataFrame, by: list[str]) -> DataFrame:
    """The newest post per link, ignoring case, within the `by` columns."""
    w = Window.partitionBy(*by, F.upper("link")).orderBy(*_newest(posts))
    return nonblank_link(posts).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def check_duplicate(posts: DataFrame, state_keys: DataFrame) -> DataFrame:
    """Posts with `is_duplicate`; keys may repeat in `state_keys`."""
    flags = state_keys.select("pk", "rk").distinct().withColumn("_seen", F.lit(True))
    joined = with_keys(posts).join(flags, ["pk", "rk"], "left")
    return joined.withColumn("is_duplicate", F.col("_seen").isNotNull()).drop("_seen")


def unprocessed_posts(posts: DataFrame, state_keys: DataFrame) -> DataFrame:
    return with_keys(posts).join(state_keys.select("pk", "rk"), ["pk", "rk"], "left_anti")


def ranked(posts: DataFrame, by: list[str], limit: int, rank: str = "rank") -> DataFrame:
    """The `limit` newest posts per `by`, ranked from 1."""
    w = Window.partitionBy(*by).orderBy(*_newest(posts))
    return posts.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= limit)


def new_posts_topk(unprocessed: DataFrame, max_items: Column, cap: int) -> DataFrame:
    """Newest `max_items` per digest; `cap` is the largest `max_items` of any request."""
    return ranked(unprocessed, ["digest_id"], cap).filter(F.col("rank") <= max_items)


def display_posts(flagged: DataFrame, max_items: Column, cap: int, limit: int = 10) -> DataFrame:
    """New posts, or the newest recent ones for a digest that has no new post.

    `flagged` is deduplicated, within the window and says `is_duplicate`. One ranking puts new
    posts first, so a digest whose first row is a duplicate has no new post; its rows then rank
    as among all recent ones. Each task passes on `cap` rows of a digest at most.
    """
    by = Window.partitionBy("digest_id")
    first = F.row_number().over(by.orderBy("is_duplicate", *_newest(flagged)))
    best = flagged.withColumn("rank", first).filter(F.col("rank") <= max(cap, limit))
    none_new = F.min("is_duplicate").over(by)
    own = ~F.col("is_duplicate") & (F.col("rank") <= max_items)
    spare = F.col("_none_new") & (F.col("rank") <= limit)
    return (
        best.withColumn("_none_new", none_new)
        .filter(own | spare)
        .withColumn("is_new_post", ~F.col("is_duplicate"))
        .drop("_none_new", "is_duplicate")
    )


def translation_slice(posts: DataFrame, limit: int = 10) -> DataFrame:
    """The first posts of each digest with a zero-based index."""
    return posts.filter(F.col("rank") <= limit).withColumn("index", F.col("rank") - 1)


def _salted_runs(runs: DataFrame, hours: str, salts: int) -> DataFrame:
    """Runs with the start of their window, once per salt; a run table is small."""
    spread = F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    start = ago(F.col("as_of"), hours=F.col(hours))
    return runs.withColumn("_start", start).withColumn("_salt", spread)


def _item_salt(salts: int) -> Column:
    return F.pmod(F.xxhash64("link", "item_pos"), F.lit(salts)).cast("int")


def runs_to_items(
    runs: DataFrame,
    items: DataFrame,
    hours: str = "new_window_hours",
    salts: int = 8,
    unit: str = "hour",
) -> DataFrame:
    """Each run sees the items of its feed group from as_of - hours to as_of, both included.

    The range is met by hour (or `unit` day, for long windows): a run is listed under each
    hour of its window, an item has one hour, and equal hours are joined. `salts` spreads a
    busy hour over several tasks: the runs, a few rows per day, are repeated instead of the
    items.
    """
    step = F.expr(f"INTERVAL 1 {unit}")
    span = F.sequence(F.date_trunc(unit, "_start"), F.date_trunc(unit, "as_of"), step)
    listed = _salted_runs(runs, hours, salts).withColumn("_slot", F.explode(span))
    keyed = items.withColumns({"_slot": F.date_trunc(unit, "published"), "_salt": _item_salt(salts)})
    return (
        keyed.join(listed, ["feed_group", "_slot", "_salt"])
        .filter("published >= _start AND published <= as_of")
        .drop("_slot", "_salt", "_start")
    )


def live_items(items: DataFrame, as_of: Column, hours: Column | int) -> DataFrame:
    """What one live request sees: everything from as_of - hours on, later items too."""
    return items.filter(F.col("published") >= ago(as_of, hours=hours))
