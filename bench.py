"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from feedloom import build_session  # noqa: E402
from feedloom.workload import catalog  # noqa: E402

HEADLINE = [
    "digest_report",
    "digest_pages",
    "w1_dedup_by_link",
    "w2_new_posts_topk",
    "w3_display_posts",
    "j1_check_duplicate",
    "j2_unprocessed_posts",
    "j3_enrich_pages",
    "j8_ticks_to_items",
    "a1_feed_status",
    "a6_errors_by_role",
    "a7_request_latency_hourly",
    "s2_parse_rss",
    "s4_load_pages",
    "s6_upsert_processed",
    "w5_recent_posts",
    "u4_distinct_nocase",
    "t2_strip_tags_full",
    "t3_first_paragraph_page",
    "t5_html_encode",
    "t8_extract_bullets",
    "t17_drop_boilerplate_lines",
    "t18_excerpt_lines_3",
    "t29_insights_en",
    "t35_digest_html",
    "n7_parse_summary_lenient",
    "r4_stream_status",
]


def spread(spark, sf: str, parts: int) -> str:
    """A copy of the tables in as many files as tasks can read at once.

    The given tables are single files of one row group, which one task reads however many cores there are.
    """
    folder = f"{tempfile.mkdtemp(prefix='bench-')}/{os.path.basename(sf.rstrip('/'))}"
    for name in sorted(os.listdir(sf)):
        if name.endswith(".parquet"):
            spark.read.parquet(f"{sf}/{name}").repartition(parts).write.parquet(f"{folder}/{name}")
    return folder


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(catalog.QUERIES)
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = spread(spark, sf, 4 * int(cpus))
    spark.read.parquet(f"{tables}/events.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
