"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.session import settle

#: Rounds grow with the logarithm of the longest chain; this is far beyond any real one.
MAX_ROUNDS = 60


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Tie each node's larger neighbours to the smallest node around it."""
    around = _both_ways(links)
    low = around.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    joined = around.filter("b > a").join(low, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Tie each node and its smaller neighbours to the smallest of them; links run from a to a lower b."""
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(low, "a")
    smaller = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return smaller.unionByName(low.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in `links` (a, b); component is its smallest reachable id.

    Alternates large-star and small-star steps until every link points at a component's smallest
    id. Each round is written to the shared folder, so a lost executor costs one round at most.
    A hot node is only ever the key of a minimum, summed up per task, and of a join that can be
    split. Links of an id with itself, nulls and repeats are ignored.
    """
    clean = links.select("a", "b").filter("a <> b")
    current = settle(
        clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    for _ in range(MAX_ROUNDS):
        starred = _large_star(current).filter("a <> b").distinct()
        following = settle(_small_star(starred).filter("a <> b").distinct(), "links")
        # Done when each id has one link and no link ends at an id that has one itself.
        onward = following.select(F.col("a").alias("b")).distinct()
        done = (
            following.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() == 0
            and following.join(onward, "b", "left_semi").limit(1).count() == 0
        )
        current = following
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    members = current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    heads = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return members.unionByName(heads)
