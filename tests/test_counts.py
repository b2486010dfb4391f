"""Counts by running totals against counting each window item by item."""

import datetime as dt
import random

from pyspark.sql import functions as F

from feedloom.operators import counts as cnt

START = dt.datetime(2024, 1, 1)


def data(spark, seed):
    rng = random.Random(seed)
    items = [
        (
            rng.choice("gh"),
            f"f{rng.randrange(4)}",
            rng.choice(["hot", "HOT", "Hot", f"l{rng.randrange(40)}", " ", None]),
            START + dt.timedelta(seconds=rng.choice([3600 * rng.randrange(200), rng.randrange(720000)]))
            if rng.random() > 0.05
            else None,
        )
        for _ in range(400)
    ]
    runs = [
        (f"d{i}", rng.choice("gh"), START + dt.timedelta(seconds=3600 * rng.randrange(220) + rng.choice([0, 0, 1234])), rng.choice([1, 2, 3]))
        for i in range(25)
    ]
    return (
        items,
        runs,
        spark.createDataFrame(items, "feed_group STRING, feed_id STRING, link STRING, published TIMESTAMP"),
        spark.createDataFrame(runs, "digest_id STRING, feed_group STRING, as_of TIMESTAMP, days_since INT"),
    )


def in_window(published, as_of, hours):
    if published is None or published > as_of:
        return False
    return published >= as_of - dt.timedelta(hours=hours)


def test_links_per_run(spark):
    for seed in (1, 2):
        items, runs, item_rows, run_rows = data(spark, seed)
        expected = {
            d: len({
                link.upper()
                for group, _, link, when in items
                if group == g and link and link.strip() and in_window(when, as_of, days * 24)
            })
            for d, g, as_of, days in runs
        }
        found = {r.digest_id: r.all_items for r in cnt.links_per_run(run_rows, item_rows).collect()}
        assert found == expected


def test_feed_counts(spark):
    items, runs, item_rows, run_rows = data(spark, 3)
    feeds = spark.createDataFrame([(f"f{i}",) for i in range(5)], "feed_id STRING")
    asked = run_rows.join(feeds).withColumns({"long": F.col("days_since") * 24, "short": F.col("days_since") * 2})
    expected = {
        (d, f"f{i}"): tuple(
            sum(group == g and feed == f"f{i}" and in_window(when, as_of, hours) for group, feed, _, when in items)
            for hours in (days * 24, days * 2)
        )
        for d, g, as_of, days in runs
        for i in range(5)
    }
    found = cnt.feed_counts(asked, item_rows, {"many": "long", "few": "short"}).collect()
    assert {(r.digest_id, r.feed_id): (r.many, r.few) for r in found} == expected
