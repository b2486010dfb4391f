"""What the physical plans must hold."""

from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from feedloom.operators import posts as pst
from feedloom.workload import tables_queries as tbq
from feedloom.workload import views as v

QUERIES = entry_point.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_of_a_link_is_picked_before_the_shuffle(spark, sf):
    text = plan(pst.dedup_by_link(v.posts(spark, sf), []))
    assert "row_number(), 1, Partial" in text


def test_top_posts_are_cut_before_the_shuffle(spark, sf):
    assert "row_number(), 30, Partial" in plan(tbq.choice(spark, sf).new_posts)


def test_time_filter_and_columns_reach_the_scan(spark, sf):
    text = plan(QUERIES["s10_load_telemetry"](spark, sf))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in text


def test_telemetry_by_day_reads_its_days(spark, sf):
    for name in ("s10_load_telemetry_by_day", "a6_errors_by_role_by_day", "a7_request_latency_hourly_by_day", "a9_calls_by_name_by_day"):
        scans = [x for x in plan(QUERIES[name](spark, sf)).split("\n") if "FileScan" in x]
        assert scans and all("(day#" in x.split("PartitionFilters: ")[1] for x in scans), name


def test_state_check_reads_keys_only(spark, sf):
    narrow = v.state_keys(spark, sf).select("pk", "rk")
    assert "korean_summary" not in plan(pst.unprocessed_posts(v.posts(spark, sf).drop("summary"), narrow))


def nodes(df, word):
    """Lines of the plan as it is before it runs that name a node."""
    lines = df._jdf.queryExecution().sparkPlan().toString().split("\n")
    return [x for x in lines if word in x]


def test_items_never_meet_runs_by_group_or_digest_alone(spark, sf):
    for name in ("a1_feed_status", "a2_digest_counts", "digest_report"):
        joins = nodes(QUERIES[name](spark, sf), "Join [")
        alone = [x for x in joins if "[feed_group#" in x.split("]")[0] and "," not in x.split("]")[0]]
        assert not [x for x in alone if "SortMergeJoin" in x], (name, alone)


def exchanges(df) -> int:
    """Shuffles of the plan before it runs, without any reuse."""
    return len([x for x in plan(df).split("\n") if "- Exchange " in x])


def test_counts_are_made_in_few_shuffles(spark, sf):
    assert exchanges(QUERIES["a2_digest_counts"](spark, sf)) <= 12


def test_no_html_is_moved(spark, sf):
    for name in ("s4_load_pages", "j3_enrich_pages"):
        text = plan(QUERIES[name](spark, sf))
        moved = [x for x in text.split("\n") if "Exchange" in x and "html#" in x]
        assert not moved, (name, moved)


def test_recent_posts_need_no_full_sort(spark, sf):
    assert "TakeOrderedAndProject" in plan(QUERIES["w5_recent_posts"](spark, sf))


def test_hot_link_sends_one_row_per_task(spark):
    """A third of all rows share one link; each task passes one of them on."""
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("link"),
        F.timestamp_seconds(F.col("id")).alias("published"),
        F.lit(0).alias("feed_pos"),
        F.col("id").alias("item_pos"),
    )
    kept = pst.dedup_by_link(rows, [])
    assert kept.count() == 20001
    assert kept.filter("link = 'hot'").collect()[0].item_pos == 29997
