"""Pages, telemetry, schedules and digest output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def usable_pages(pages: DataFrame, need_html_type: bool = True) -> DataFrame:
    """Pages that were fetched, and are html if that is asked for."""
    usable = pages.filter(F.col("status").between(200, 299) & F.col("html").isNotNull())
    if need_html_type:
        usable = usable.filter(F.contains(F.lower("content_type"), F.lit("html")))
    return usable


def load_pages(
    pages: DataFrame, need_html_type: bool = True, links: DataFrame | None = None, **texts: Column
) -> DataFrame:
    """One row per url, case ignored, with columns made from the page's html.

    `texts` names the columns that are wanted, as expressions of `html`; they are made where the
    page lies, so no html is moved. Of several copies of a page the one with the smallest MD5
    wins. With `links` (a column `link`) only the pages that are linked to are read.
    """
    usable = usable_pages(pages, need_html_type).withColumn("url", F.lower("url"))
    if links is not None:
        wanted = links.select(F.lower("link").alias("url")).distinct()
        usable = usable.join(wanted, "url", "left_semi")
    made = usable.withColumn("_md5", F.md5("html")).withColumns(
        {f"_t_{name}": text for name, text in texts.items()}
    )
    first = F.min(F.struct("_md5", *[f"_t_{name}" for name in texts])).alias("_p")
    kept = made.select("url", "_md5", *[f"_t_{name}" for name in texts]).groupBy("url").agg(first)
    return kept.select("url", *[F.col(f"_p._t_{name}").alias(name) for name in texts])


#: Column that telemetry is laid out by.
DAY = "day"


def write_telemetry(rows: DataFrame, path: str, batch: str, ts: str = "ts") -> None:
    """Telemetry in folders by day and batch. A batch that is written again replaces its own rows and no others."""
    dated = rows.withColumns({DAY: F.to_date(ts), "batch": F.lit(batch)})
    # Spark evens out the files: a busy day is split, quiet ones share a task.
    files = dated.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    files.partitionBy(DAY, "batch").parquet(path)


def read_telemetry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Telemetry as `write_telemetry` lays it out; filters on time then read only their days."""
    return spark.read.schema(f"{schema}, {DAY} DATE, batch STRING").parquet(path).drop("batch")


def on_days(rows: DataFrame, since: Column) -> DataFrame:
    """Rows of the days from that of `since` on, if the table is laid out by day; else all rows."""
    if dict(rows.dtypes).get(DAY) != "date":
        return rows
    return rows.filter(F.col(DAY) >= F.to_date(since))


def load_telemetry(rows: DataFrame, since: Column, ts: str = "ts") -> DataFrame:
    """Telemetry rows from `since` on; the filter reaches the scan, and prunes the days of a table that has them."""
    return on_days(rows, since).filter(F.col(ts) >= since)


def schedule_ticks(spans: DataFrame) -> DataFrame:
    """Run times for each day of a span.

    `spans`: feed_group, hours ARRAY<INT>, tz, first_day DATE, last_day DATE. A tick is UTC.
    """
    days = spans.select(
        "feed_group",
        "hours",
        "tz",
        F.explode(F.sequence("first_day", "last_day")).alias("day"),
    )
    hours = days.select("feed_group", "tz", "day", F.explode("hours").alias("hour"))
    local = F.col("day").cast("timestamp") + F.make_dt_interval(hours=F.col("hour"))
    return hours.select(
        "feed_group", "day", "hour", F.to_utc_timestamp(local, F.col("tz")).alias("tick")
    )


def write_digests(digests: DataFrame, path: str, fmt: str = "json") -> None:
    """Digests in folders by feed group, day of the run (from `as_of`) and digest.

    Only the folders of the digests at hand are replaced: earlier runs stay, also those of the same day, and a replay
    changes nothing.
    """
    dated = digests.withColumn("run_day", F.to_date("as_of")).drop("as_of")
    files = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    files.partitionBy("feed_group", "run_day", "digest_id").format(fmt).save(path)


def read_digests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Written digests; a filter on feed_group, run_day or digest_id reads only their folders."""
    schema = "subject STRING, html STRING, feed_group STRING, run_day DATE, digest_id STRING"
    return spark.read.schema(schema).format(fmt).load(path)
