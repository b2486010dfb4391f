"""Streams over the given tables, each against its batch counterpart in SQL.

Every stream reads five batches in an order that is neither that of publication nor of numbers, and
some rows are dated far ahead.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions.dates import format_iso
from feedloom.operators.commits import folder_at
from feedloom.operators.posts import with_keys
from feedloom.operators.state import ProcessedPosts, to_state_rows
from feedloom.session import settle, shared_dir
from feedloom.streaming import streams as stm
from feedloom.workload import tables_queries as tbq
from feedloom.workload import views as v
from feedloom.workload.registry import SQL, query
from feedloom.workload.views import AS_OF_SQL, ISO, PK_SQL, POSTS_SQL, PROCESSED_SQL, RK_SQL

C = F.col

#: Parts (number modulo five) in the order of their arrival, half a day apart.
ARRIVAL = [3, 0, 4, 1, 2]
FETCHED_SQL = f"{AS_OF_SQL} + INTERVAL 12 HOUR * (list_position({ARRIVAL}, n % 5) - 1)"


def _turn(number):
    turns = F.array(*[F.lit(ARRIVAL.index(p)) for p in range(5)])
    return F.get(turns, (number % 5).cast("int"))


def _fetched(number):
    return v.as_of() + F.make_dt_interval(hours=_turn(number) * 12)


def _arrivals(spark, rows, number, label: str, run):
    """Hand `rows` to `run` as a stream that is started anew for each of five parts, in the order of their arrival.

    All parts are written by one job, each as as many files as tasks wrote it; a part arrives when its folder is moved
    to where the stream looks.
    """
    kept, seen = shared_dir(spark, label), shared_dir(spark, label)
    rows.withColumn("_turn", _turn(number)).write.partitionBy("_turn").option("compression", "zstd").parquet(kept)
    for turn in range(len(ARRIVAL)):
        part, files = folder_at(spark, f"{kept}/_turn={turn}")
        if not files.exists(part):
            continue
        arrived, _ = folder_at(spark, f"{seen}/part-{turn}")
        files.mkdirs(arrived.getParent())
        files.rename(part, arrived)
        run(stm.payload_stream(spark, f"{seen}/*", rows.schema))


@query("r1_stream_ingest", SQL["s2_parse_rss"])
def _(spark, sf):
    rows = tbq.rss_payloads(spark, sf).withColumn("n", F.substring("feed_id", 2, 20).cast("bigint"))
    out, check = shared_dir(spark, "items"), shared_dir(spark, "check")
    _arrivals(spark, rows, C("n"), "payloads", lambda s: stm.run_append(stm.stream_ingest(s.drop("n")), out, check))
    return spark.read.parquet(out).select(
        "feed_id",
        C("item_pos").cast("bigint").alias("item_pos"),
        "title",
        "link",
        F.md5("summary").alias("summary_md5"),
        format_iso(C("published")).alias("published"),
        F.array_join("categories", ",").alias("categories"),
    )


@query(
    "r1_stream_rejects",
    f"""WITH {POSTS_SQL}, found AS (
  SELECT 'f' || item_pos AS feed_id, CASE lang WHEN 'de' THEN 'HTTP 503' WHEN 'es' THEN 'HTML instead of XML'
    WHEN 'fr' THEN 'Not XML format' END AS error, published, item_pos FROM posts)
SELECT feed_id, error AS reason, NULL::BIGINT AS item_pos, NULL AS link_md5, 'reject' AS kind FROM found WHERE error IS NOT NULL
UNION ALL
SELECT feed_id, NULL, pos, CASE pos WHEN 0 THEN md5(link) ELSE md5('') END, 'item'
FROM found JOIN (SELECT item_pos AS n, link FROM posts) ON n = item_pos, (VALUES (0::BIGINT), (1::BIGINT)) t(pos)
WHERE error IS NULL AND NOT (pos = 0 AND item_pos % 7 = 0)
UNION ALL
SELECT feed_id, 'no readable date', 0, md5(link), 'reject' FROM found JOIN (SELECT item_pos AS n, link FROM posts) ON n = item_pos
WHERE error IS NULL AND item_pos % 7 = 0""",
)
def _(spark, sf):
    """Items and rejects side by side: failed payloads, html, texts that are no feed, and items with a date that cannot be read."""
    posts = v.posts(spark, sf).select(F.concat(F.lit("f"), C("item_pos").cast("string")).alias("feed_id"), "item_pos", "lang", "title")
    plain = F.when(C("item_pos") % 7 == 0, F.regexp_replace("body", "<pubDate>[^<]*<", "<pubDate>some day<")).otherwise(C("body"))
    body = (
        F.when(C("lang") == "es", F.concat(F.lit("<HTML>"), C("body"))).when(C("lang") == "fr", C("title")).otherwise(plain)
    )
    rows = tbq.rss_payloads(spark, sf).join(posts, "feed_id").withColumn("body", body).drop("lang", "title")
    out, check = shared_dir(spark, "outcomes"), shared_dir(spark, "check")

    def run(stream):
        stm.run_append(stm.stream_outcomes(stream.drop("item_pos")), out, check, by="kind")

    _arrivals(spark, rows, C("item_pos"), "payloads", run)
    return spark.read.parquet(out).select(
        "feed_id", "reason", C("item_pos").cast("bigint").alias("item_pos"), F.md5("link").alias("link_md5"), "kind"
    )


ARRIVED_SQL = f"""{POSTS_SQL}, arrived AS (
  SELECT {PK_SQL} AS pk, {RK_SQL} AS rk, title, link, source_name, n,
    CASE WHEN n % 97 = 5 THEN published + INTERVAL 75 YEAR ELSE published END AS published,
    {FETCHED_SQL} AS fetched_at FROM (SELECT *, item_pos AS n FROM posts))"""


def _posts(spark, sf, run):
    n = C("item_pos")
    ahead = F.when(n % 97 == 5, F.expr("published + INTERVAL 75 YEARS")).otherwise(C("published"))
    rows = v.posts(spark, sf).select(
        "item_pos", "title", "link", "source_name", "summary", ahead.alias("published"), _fetched(n).alias("fetched_at")
    )
    _arrivals(spark, rows, n, "posts", run)


@query(
    "r2_stream_dedup",
    f"""WITH {ARRIVED_SQL} SELECT pk, rk, strftime(min(fetched_at), {ISO}) AS fetched_at
FROM arrived GROUP BY 1, 2""",
)
def _(spark, sf):
    """The first sighting of each key, by arrival, over five starts of the stream."""
    out, check = shared_dir(spark, "firsts"), shared_dir(spark, "check")

    def run(posts):
        stm.run_append(stm.stream_dedup(posts).select("pk", "rk", "published", "fetched_at"), out, check)

    _posts(spark, sf, run)
    return spark.read.parquet(out).select("pk", "rk", format_iso(C("fetched_at")).alias("fetched_at"))


@query(
    "r2_stream_dedup_after_state",
    f"""WITH {ARRIVED_SQL}, handled AS (
  SELECT {PK_SQL} AS pk, {RK_SQL} AS rk FROM posts p JOIN labels l ON p.item_pos = l.doc_id)
SELECT pk, rk, strftime(min(fetched_at), {ISO}) AS fetched_at FROM arrived a
WHERE NOT EXISTS (SELECT 1 FROM handled h WHERE h.pk = a.pk AND h.rk = a.rk) GROUP BY 1, 2""",
)
def _(spark, sf):
    """First sightings of what the state table did not hold when the stream began."""
    labels = v.table(spark, sf, "labels").select(C("doc_id").alias("item_pos"))
    known = settle(with_keys(v.posts(spark, sf).join(labels, "item_pos", "left_semi")).select("pk", "rk"), "known")
    out, check = shared_dir(spark, "firsts"), shared_dir(spark, "check")

    def run(posts):
        stm.run_append(stm.stream_dedup(posts, known).select("pk", "rk", "fetched_at"), out, check)

    _posts(spark, sf, run)
    return spark.read.parquet(out).select("pk", "rk", format_iso(C("fetched_at")).alias("fetched_at"))


@query(
    "r3_stream_upsert",
    f"""WITH {ARRIVED_SQL} SELECT pk, rk, title, link, source_name, strftime(published, {ISO}) AS publish_date,
  strftime(fetched_at, {ISO}) AS processed_date FROM arrived
QUALIFY row_number() OVER (PARTITION BY pk, rk ORDER BY fetched_at DESC, link, title, published) = 1""",
)
def _(spark, sf):
    bullets = F.array("title")
    state, check = ProcessedPosts(spark, shared_dir(spark, "state")), shared_dir(spark, "check")

    def run(posts):
        full = posts.withColumns({"english_summary": bullets, "korean_summary": bullets})
        stm.run_batches(to_state_rows(full, C("fetched_at")), stm.upsert_batch(state, "posts"), check)

    _posts(spark, sf, run)
    return state.rows().select(
        "pk", "rk", "title", "link", "source_name", "publish_date",
        format_iso(C("processed_date")).alias("processed_date"),
    )


TIMED_SQL = """timed AS (
  SELECT event_type, value, CASE WHEN event_id % 997 = 3 THEN ts + INTERVAL 10 YEAR ELSE ts END AS moment FROM events)"""


def _events(spark, sf, run):
    n = C("event_id")
    ahead = F.when(n % 997 == 3, F.expr("ts + INTERVAL 10 YEARS")).otherwise(C("ts"))
    _arrivals(spark, v.events(spark, sf).withColumn("ts", ahead), n, "events", run)


@query(
    "r4_stream_status",
    f"""WITH {TIMED_SQL} SELECT strftime(date_trunc('hour', moment) - INTERVAL 1 HOUR * k, {ISO}) AS start,
  event_type AS feed_id, count(*) AS items
FROM timed, (SELECT unnest(range(24)) AS k) GROUP BY 1, 2""",
)
def _(spark, sf):
    sums, check = stm.StreamedSums(spark, shared_dir(spark, "status"), ["hour", "feed_id"], fan=2), shared_dir(spark, "check")

    def run(events):
        items = events.select(C("ts").alias("published"), C("event_type").alias("feed_id"))
        stm.run_batches(items, sums.sink(stm.hourly_status), check)

    _events(spark, sf, run)
    found = stm.status_windows(sums.read())
    return found.withColumn("start", format_iso(C("start")))


@query(
    "r5_stream_latency",
    f"""WITH {TIMED_SQL} SELECT strftime(date_trunc('hour', moment), {ISO}) AS hour, event_type AS name,
  sum(value::DECIMAL(20, 6))::DOUBLE / count(value) AS avg_duration, max(value) AS max_duration, count(*) AS n
FROM timed GROUP BY 1, 2""",
)
def _(spark, sf):
    path, check = shared_dir(spark, "latency"), shared_dir(spark, "check")
    sums = stm.StreamedSums(spark, path, ["hour", "name"], ("max_duration",), fan=2)

    def run(events):
        requests = events.select("ts", C("event_type").alias("name"), C("value").alias("duration"))
        stm.run_batches(requests, sums.sink(stm.hourly_latency), check)

    _events(spark, sf, run)
    found = stm.latency(sums.read())
    return found.withColumn("hour", format_iso(C("hour")))


@query(
    "r6_stream_payloads_to_state",
    f"""WITH {PROCESSED_SQL}, items AS (
  SELECT {PK_SQL} AS pk, {RK_SQL} AS rk, {tbq.trim("title")} AS title, link, source_name, published,
    {FETCHED_SQL} AS fetched_at
  FROM (SELECT *, item_pos AS n FROM posts WHERE lang <> 'de')),
fresh AS (
  SELECT * FROM items i WHERE NOT EXISTS (SELECT 1 FROM processed s WHERE s.pk = i.pk AND s.rk = i.rk)
  QUALIFY row_number() OVER (PARTITION BY pk, rk ORDER BY fetched_at, link, title, published) = 1),
old AS (
  SELECT * FROM processed QUALIFY row_number() OVER (
    PARTITION BY pk, rk ORDER BY processed_date DESC NULLS LAST, link, title, publish_date) = 1)
SELECT pk, rk, link, strftime(processed_date, {ISO}) AS processed_date FROM old
UNION ALL SELECT pk, rk, link, strftime(fetched_at, {ISO}) FROM fresh""",
)
def _(spark, sf):
    """One stream from payloads to the state table, which already holds some posts."""
    n = F.substring("feed_id", 2, 20).cast("bigint")
    dated = v.settled_posts(spark, sf)
    rows = tbq.rss_payloads(spark, sf, dated).withColumn("n", n).withColumn("fetched_at", _fetched(C("n")))
    feeds = dated.select(
        F.concat(F.lit("f"), C("item_pos").cast("string")).alias("feed_id"), "feed_group", "feed_pos",
        "source_name", F.lit(None).cast("string").alias("emoji"),
    )
    state = ProcessedPosts(spark, shared_dir(spark, "state"))
    state.append(v.processed(spark, sf, dated), 0)
    sink, check = stm.items_to_state(state, settle(feeds, "feeds"), "payloads"), shared_dir(spark, "check")
    _arrivals(spark, rows, C("n"), "payloads", lambda s: stm.run_batches(stm.stream_ingest(s.drop("n")), sink, check))
    return state.rows().select("pk", "rk", "link", format_iso(C("processed_date")).alias("processed_date"))
