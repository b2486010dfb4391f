"""Feed health, digest counts and telemetry aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.constants import ERROR_NO_HANGUL, NOT_XML, NOT_XML_HTML
from feedloom.functions.dates import ago, bin_hour
from feedloom.functions.html import contains_hangul
from feedloom.functions.text import no_strings
from feedloom.operators.filters import is_new, is_placeholder
from feedloom.sources.feeds import classify_payload, entry_count, status_source_default
from feedloom.sources.tables import on_days


def feed_status(feeds: DataFrame, items: DataFrame) -> DataFrame:
    """One row per run and feed; a feed without items or with an error stays, with zeros.

    `feeds`: digest_id, feed_id, source_name, url, feed_pos, error, elapsed_ms, as_of and
    new_window_hours. `items`: digest_id, feed_id, published; blank links count. Items are
    counted per feed before they meet the feeds.
    """
    runs = feeds.select("digest_id", "as_of", "new_window_hours").distinct()
    new = is_new(F.col("as_of"), F.col("new_window_hours"))
    return status_from_counts(
        feeds,
        items.select("digest_id", "feed_id", "published")
        .join(runs, "digest_id")
        .groupBy("digest_id", "feed_id")
        .agg(F.count(F.lit(1)).alias("items"), F.count_if(new).alias("items_new")),
    )


def status_from_counts(feeds: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per run and feed from counts per digest_id and feed_id."""
    counts = counts.select(
        "digest_id", "feed_id", F.col("items").alias("_items"), F.col("items_new").alias("_new")
    )
    ok = F.col("error").isNull()
    joined = feeds.join(counts, ["digest_id", "feed_id"], "left")
    return joined.select(
        "digest_id",
        "feed_id",
        "feed_pos",
        status_source_default(F.col("source_name")).alias("source_name"),
        "url",
        ok.alias("ok"),
        F.when(ok, F.coalesce("_items", F.lit(0))).otherwise(0).cast("bigint").alias("items"),
        F.when(ok, F.coalesce("_new", F.lit(0))).otherwise(0).cast("bigint").alias("items_new"),
        "elapsed_ms",
        "error",
    )


def _placed(rows: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """Rows with their `position` from 1; no global sort is needed to tell the order."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def status_by_name(statuses: DataFrame) -> DataFrame:
    """Statuses with their position in summary order: by source name, ignoring case."""
    return _placed(statuses, ["digest_id"], F.upper("source_name"), "feed_pos", "feed_id")


def status_as_listed(statuses: DataFrame) -> DataFrame:
    """Statuses with their position in detail order: as the feeds are listed."""
    return _placed(statuses, ["digest_id"], "feed_pos", "feed_id")


def payload_error(http_status: Column, body: Column, error: Column) -> Column:
    """Why a payload yields no items, else null."""
    kind = classify_payload(body)
    return (
        F.when(error.isNotNull(), error)
        .when(~http_status.between(200, 299), F.concat(F.lit("HTTP "), http_status.cast("string")))
        .when(kind == "html", F.lit(NOT_XML_HTML))
        .when(kind == "other", F.lit(NOT_XML))
    )


def payload_report(payloads: DataFrame) -> DataFrame:
    """Each payload with its kind, entry count and, if unusable, the reason."""
    reason = payload_error(F.col("http_status"), F.col("body"), F.col("error"))
    return payloads.select(
        "feed_id",
        classify_payload(F.col("body")).alias("kind"),
        entry_count(F.col("body")).cast("bigint").alias("entries"),
        reason.alias("reason"),
    )


def payload_summary(payloads: DataFrame) -> DataFrame:
    """Valid and invalid payloads, counted by reason."""
    valid = F.col("reason").isNull()
    return (
        payload_report(payloads)
        .groupBy(valid.alias("valid"), F.coalesce("reason", F.lit("OK")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("payloads"), F.sum("entries").alias("entries"))
    )


def digest_counts(links: DataFrame, shown: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts per digest; a digest without posts keeps its row with zeros.

    `links` holds digest_id and all_items; `shown` the display posts with is_new_post.
    """
    recent = is_new(F.col("as_of"), F.col("new_window_hours"))
    names = ["all_items", "new_posts", "display_posts", "recent_posts"]
    # Runs, links and posts are rows of one kind that are added up once.
    parts = [
        (runs, {}),
        (links, {"all_items": F.col("all_items")}),
        (shown, {"new_posts": F.col("is_new_post").cast("int"), "display_posts": F.lit(1), "recent_posts": recent.cast("int")}),
    ]
    rows = [
        part.select(
            "digest_id",
            *[F.coalesce(values.get(n, F.lit(0)), F.lit(0)).cast("bigint").alias(n) for n in names],
            F.lit(not values).alias("_asked"),
        )
        for part, values in parts
    ]
    summed = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("digest_id")
    added = summed.agg(*[F.sum(n).alias(n) for n in names], F.max("_asked").alias("_asked"))
    return added.filter("_asked").drop("_asked")


def actual_new_count(posts: DataFrame) -> DataFrame:
    """Posts to show per digest that are not placeholders."""
    real = ~is_placeholder(F.col("title"), F.col("summary"))
    return posts.groupBy("digest_id").agg(
        F.count_if(real).alias("actual_new"), F.count(F.lit(1)).alias("shown")
    )


def translated_posts(posts: DataFrame) -> DataFrame:
    """Posts per digest with Hangul in any bullet."""
    ko = F.exists(F.coalesce("korean_summary", no_strings()), contains_hangul)
    counted = posts.groupBy("digest_id").agg(F.count_if(ko).alias("translated_posts"))
    done = F.col("translated_posts") > 0
    return counted.withColumns(
        {
            "succeeded": done,
            "error": F.when(~done, F.lit(ERROR_NO_HANGUL)),
        }
    )


# --- telemetry ---------------------------------------------------------------------------


def _after(rows: DataFrame, bound: Column) -> DataFrame:
    """Rows later than `bound`; of a table laid out by day, only its days are read."""
    return on_days(rows, bound).filter(F.col("ts") > bound)


def errors_by_role(traces: DataFrame, as_of: Column) -> DataFrame:
    """Traces of the last 24 hours with severity 3 or more, by role and severity."""
    recent = _after(traces, ago(as_of, hours=24)).filter("severity >= 3")
    return recent.groupBy("role", "severity").agg(F.count(F.lit(1)).alias("n"))


def recent_errors(traces: DataFrame, as_of: Column) -> DataFrame:
    """The same traces, newest first, without a limit."""
    recent = _after(traces, ago(as_of, hours=24)).filter("severity >= 3")
    return recent.select("ts", "message", "severity").orderBy(
        F.col("ts").desc(), "message", "severity"
    )


def exact_avg(name: str) -> Column:
    """Mean by way of a decimal sum, so that the order of the parts does not show."""
    return F.sum(F.col(name).cast("decimal(20,6)")).cast("double") / F.count(name)


def request_latency_hourly(
    requests: DataFrame, name: str, as_of: Column | None = None
) -> DataFrame:
    """Average and maximum duration and count per hour; seven days back from `as_of`."""
    rows = requests.filter(F.col("name") == name)
    if as_of is not None:
        rows = _after(rows, ago(as_of, days=7))
    return rows.groupBy(bin_hour(F.col("ts")).alias("hour")).agg(
        exact_avg("duration").alias("avg_duration"),
        F.max("duration").alias("max_duration"),
        F.count(F.lit(1)).alias("n"),
    )


def feed_failure_counts(traces: DataFrame, phrase: str = "Feed fetch failed") -> DataFrame:
    """Failed fetches per url; a trace without a url counts under ''."""
    failed = F.contains(F.lower("message"), F.lit(phrase.lower()))
    url = F.coalesce(F.try_element_at("dims", F.lit("Url")), F.lit(""))
    return traces.filter(failed).groupBy(url.alias("url")).agg(F.count(F.lit(1)).alias("n"))


def calls_by_name(requests: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """Calls per name with their position, most calls first, then by name.

    Names are few by nature; the ranking sees one row per name.
    """
    recent = _after(requests, ago(as_of, hours=hours))
    counted = recent.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return _placed(counted.withColumn("_all", F.lit(0)), ["_all"], F.col("n").desc(), "name").drop("_all")


def recent_exceptions(exceptions: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    """The newest exceptions of the last 24 hours."""
    recent = _after(exceptions, ago(as_of, hours=24))
    newest = recent.select("ts", "type", "outer_message").orderBy(
        F.col("ts").desc(), "type", "outer_message"
    )
    return _placed(
        newest.limit(limit).withColumn("_all", F.lit(0)), ["_all"], F.col("ts").desc(), "type", "outer_message"
    ).drop("_all")
