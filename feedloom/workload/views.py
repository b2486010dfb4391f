"""Digest tables derived from the given tables, in Spark and as SQL text.

A document is a post, the event with its number dates it, a label marks it as processed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.dates import format_iso
from feedloom.functions.keys import partition_key, row_key
from feedloom.session import settle

AS_OF_TEXT = "2024-01-03 12:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF_TEXT}'"


def as_of():
    return F.lit(AS_OF_TEXT).cast("timestamp")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table for work on its texts; `spark.sql.files` settings decide how finely it is read."""
    return table(spark, sf, name)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _feed_pos(source):
    return F.coalesce(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("int"), F.lit(0))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Posts without a date."""
    docs = texts(spark, sf, "documents")
    url = F.concat(F.lit("https://blog.example/"), F.md5("text"))
    pos = _feed_pos(F.col("source"))
    return docs.select(
        F.col("doc_id").alias("item_pos"),
        F.col("source").alias("feed_id"),
        F.col("source").alias("source_name"),
        pos.alias("feed_pos"),
        F.when(pos % 2 == 0, "security").otherwise("azureCloud").alias("feed_group"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.when(F.col("doc_id") % 2 == 1, F.upper(url)).otherwise(url).alias("link"),
        F.col("text").alias("summary"),
        "lang",
        "n_chars",
    )


DOCUMENTS_SQL = """
docs AS (
  SELECT doc_id AS item_pos, source AS feed_id, source AS source_name,
    coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) AS feed_pos,
    CASE WHEN coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) % 2 = 0
      THEN 'security' ELSE 'azureCloud' END AS feed_group,
    split_part(text, chr(10), 1) AS title,
    CASE WHEN doc_id % 2 = 1 THEN upper('https://blog.example/' || md5(text))
      ELSE 'https://blog.example/' || md5(text) END AS link,
    text AS summary, lang, n_chars
  FROM documents)"""


def posts(spark: SparkSession, sf: str) -> DataFrame:
    dates = events(spark, sf).select(
        F.col("event_id").alias("item_pos"), F.date_trunc("second", "ts").alias("published")
    )
    return documents(spark, sf).join(dates, "item_pos")


POSTS_SQL = f"""{DOCUMENTS_SQL},
posts AS (
  SELECT d.*, date_trunc('second', e.ts) AS published
  FROM docs d JOIN events e ON d.item_pos = e.event_id)"""


def settled_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts for queries that read them several times: their texts meet their dates once."""
    return settle(posts(spark, sf), "dated", codec="zstd")


def processed(spark: SparkSession, sf: str, dated: DataFrame | None = None) -> DataFrame:
    """Labelled posts and those around midnight as rows of the state table; `dated`: posts that were read before.

    Some lack bullets or a processed date. A run at night finds nothing new.
    """
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("item_pos"), "quality", "toxic", F.lit(True).alias("labelled")
    )
    marked = (posts(spark, sf) if dated is None else dated).join(labels, "item_pos", "left")
    return marked.filter(F.col("labelled") | F.hour("published").isin(23, 0)).select(
        partition_key(F.col("source_name")).alias("pk"),
        row_key(F.col("link")).alias("rk"),
        "title",
        "link",
        "source_name",
        "summary",
        format_iso(F.col("published")).alias("publish_date"),
        F.to_json(F.array("title", "lang")).alias("english_summary"),
        F.when(F.col("toxic") == 0, F.to_json(F.array("lang"))).alias("korean_summary"),
        F.when(F.col("quality") == 1, F.expr("published + INTERVAL 1 HOUR")).alias(
            "processed_date"
        ),
        F.expr("published + INTERVAL 2 HOURS").alias("ts"),
    )


PK_SQL = "replace(coalesce(source_name, 'Unknown'), ' ', '')"
RK_SQL = "replace(replace(to_base64(unhex(sha256(coalesce(link, '')))), '/', '_'), '+', '-')"
ISO = "'%Y-%m-%dT%H:%M:%SZ'"

PROCESSED_SQL = f"""{POSTS_SQL},
processed AS (
  SELECT {PK_SQL} AS pk, {RK_SQL} AS rk, title, link, source_name, summary,
    strftime(published, {ISO}) AS publish_date,
    [title, lang] AS english_list,
    CASE WHEN toxic = 0 THEN [lang] ELSE [] END AS korean_list,
    CASE WHEN quality = 1 THEN published + INTERVAL 1 HOUR END AS processed_date,
    published + INTERVAL 2 HOUR AS ts
  FROM posts p LEFT JOIN labels l ON p.item_pos = l.doc_id
  WHERE l.doc_id IS NOT NULL OR hour(published) IN (23, 0))"""


def state_keys(spark: SparkSession, sf: str) -> DataFrame:
    return processed(spark, sf).select("pk", "rk")


def feeds(spark: SparkSession, sf: str) -> DataFrame:
    """One feed per source; some have a blank url or no name."""
    names = table(spark, sf, "documents").select(F.col("source").alias("feed_id")).distinct()
    pos = _feed_pos(F.col("feed_id"))
    return names.select(
        "feed_id",
        F.when(pos % 2 == 0, "security").otherwise("azureCloud").alias("feed_group"),
        pos.alias("feed_pos"),
        F.when(pos == 3, F.lit(None)).when(pos == 4, " ").otherwise(F.col("feed_id")).alias(
            "source_name"
        ),
        F.when(pos == 5, " ").otherwise(F.concat(F.lit("https://"), "feed_id")).alias("url"),
        F.when(pos % 3 == 0, "🛡️").alias("emoji"),
        F.lit("security").alias("category"),
        (pos % 4 != 1).alias("active"),
    )


FEEDS_SQL = """
feeds0 AS (
  SELECT source AS feed_id,
    coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) AS feed_pos
  FROM (SELECT DISTINCT source FROM documents)),
feeds AS (
  SELECT feed_id, CASE WHEN feed_pos % 2 = 0 THEN 'security' ELSE 'azureCloud' END AS feed_group,
    feed_pos,
    CASE WHEN feed_pos = 3 THEN NULL WHEN feed_pos = 4 THEN ' ' ELSE feed_id END AS source_name,
    CASE WHEN feed_pos = 5 THEN ' ' ELSE 'https://' || feed_id END AS url,
    CASE WHEN feed_pos % 3 = 0 THEN '🛡️' END AS emoji,
    'security' AS category, feed_pos % 4 <> 1 AS active
  FROM feeds0)"""


#: Runs of a day: name, hours after midnight, days_since and max_items and window as asked for. At noon
#: one group asks for a window longer than its days; at night all is handled; a month early there is nothing.
RUN_KINDS = [("", 12.0, None, 0, None), ("night-", 0.5, 2, 5, 1), ("early-", -720.0, 30, -1, 24)]


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs for each day and feed group that has posts."""
    days = (
        posts(spark, sf)
        .select("feed_group", F.to_date("published").alias("day"))
        .distinct()
    )
    kinds = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("name"), F.lit(int(hours * 60)).alias("minutes"),
                    F.lit(days).cast("int").alias("days"), F.lit(items).alias("items"),
                    F.lit(window).cast("int").alias("window"),
                )
                for name, hours, days, items, window in RUN_KINDS
            ]
        )
    )
    security = F.col("feed_group") == "security"
    return days.withColumn("k", kinds).select(
        F.concat("feed_group", F.lit("-"), "k.name", F.date_format("day", "yyyyMMdd")).alias("digest_id"),
        "feed_group",
        (F.col("day").cast("timestamp") + F.make_dt_interval(mins=F.col("k.minutes"))).alias("as_of"),
        F.coalesce("k.days", F.when(security, 30).otherwise(1)).alias("days_since"),
        F.col("k.items").alias("max_items"),
        F.coalesce("k.window", F.when(security, 24).otherwise(36)).alias("new_window_hours"),
        F.lit(" ").alias("schedule_text"),
    )


RUNS_SQL = """
runs AS (
  SELECT feed_group || '-' || name || strftime(day, '%Y%m%d') AS digest_id, feed_group,
    day + INTERVAL 1 MINUTE * minutes AS as_of,
    coalesce(days, CASE WHEN feed_group = 'security' THEN 30 ELSE 1 END) AS days_since,
    CASE WHEN items > 0 THEN items ELSE 12 END AS max_items,
    coalesce(win, CASE WHEN feed_group = 'security' THEN 24 ELSE 36 END) AS new_window_hours
  FROM (SELECT DISTINCT feed_group, date_trunc('day', published)::TIMESTAMP AS day FROM posts),
    (VALUES ('', 720, NULL, 0, NULL), ('night-', 30, 2, 5, 1), ('early-', -43200, 30, -1, 24))
      k(name, minutes, days, items, win))"""
# The hours that a run sees, and those that its feed states call new.
HOURS_SQL = "least(r.days_since * 24, r.new_window_hours)"


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Fetched pages: links with a fragment failed, those with a query are no html."""
    url = F.col("url")
    return table(spark, sf, "pages").select(
        F.regexp_replace("url", "[?#].*$", "").alias("url"),
        F.when(F.contains(url, F.lit("#")), 404).otherwise(200).alias("status"),
        F.when(F.contains(url, F.lit("?")), "application/pdf")
        .otherwise("Text/HTML; charset=utf-8")
        .alias("content_type"),
        "html",
    )


PAGES_SQL = """
fetched AS (
  SELECT regexp_replace(url, '[?#].*$', '') AS url,
    CASE WHEN contains(url, '#') THEN 404 ELSE 200 END AS status,
    CASE WHEN contains(url, '?') THEN 'application/pdf' ELSE 'Text/HTML; charset=utf-8' END
      AS content_type, html
  FROM pages)"""


def linked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages under the link of the document with their number: url, status, html."""
    links = documents(spark, sf).select(F.col("item_pos").alias("page_id"), "link")
    status = F.when(F.contains("url", F.lit("#")), 404).otherwise(200)
    return table(spark, sf, "pages").join(links, "page_id").select(
        F.col("link").alias("url"), status.alias("status"), "html"
    )


LINKED_SQL = """
linked AS (
  SELECT lower(d.link) AS k, p.html FROM pages p JOIN docs d ON d.item_pos = p.page_id
  WHERE NOT contains(p.url, '#'))"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        "ts", F.col("event_type").alias("name"), F.col("value").alias("duration")
    )


def traces(spark: SparkSession, sf: str) -> DataFrame:
    """Event rows as log lines; some name a failed feed and its url."""
    kind, user = F.col("event_type"), F.col("user_id")
    url = F.concat(F.lit("https://feed/"), (user % 17).cast("string"))
    return events(spark, sf).select(
        "ts",
        (user % 5).cast("int").alias("severity"),
        F.when(kind == "error", F.concat(F.lit("feed FETCH failed: "), url))
        .otherwise(F.concat(F.lit("handled "), kind))
        .alias("message"),
        kind.alias("role"),
        F.when(user % 2 == 0, F.create_map(F.lit("Url"), url))
        .otherwise(F.create_map(F.lit("Host"), F.lit("x")))
        .alias("dims"),
    )


TRACES_SQL = """
traces AS (
  SELECT ts, (user_id % 5)::INT AS severity,
    CASE WHEN event_type = 'error' THEN 'feed FETCH failed: https://feed/' || (user_id % 17)
      ELSE 'handled ' || event_type END AS message,
    event_type AS role,
    CASE WHEN user_id % 2 = 0 THEN 'https://feed/' || (user_id % 17) ELSE '' END AS url
  FROM events)"""
