"""Scans, filters, joins, aggregates, ranking and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions.constants import (
    DEFAULT_EMOJI,
    DEFAULT_SCHEDULE_TEXT,
    EMPTY_EN,
    EMPTY_KO,
    PLACEHOLDER_SUMMARY,
    PLACEHOLDER_TITLES,
    SUBJECT_NEW,
    SUBJECT_NONE,
)
from feedloom.functions.dates import format_iso, published_or_updated
from feedloom.functions.keys import EMOJI_MAPS, source_emoji
from feedloom.operators import filters as flt
from feedloom.operators import posts as pst
from feedloom.operators import rows as rws
from feedloom.operators import state as stt
from feedloom.operators import status as sts
from feedloom.operators.render import subject_line
from feedloom.plans.digest import choose_posts, counts_per_feed
from feedloom.session import settle, shared_dir
from feedloom.sources import feeds as fds
from feedloom.sources import tables as tbs
from feedloom.streaming import streams as stm
from feedloom.workload import views as v
from feedloom.workload.registry import SQL, query
from feedloom.workload.sqltext import decode, quoted, trim
from feedloom.workload.views import (
    AS_OF_SQL,
    DOCUMENTS_SQL,
    FEEDS_SQL,
    HOURS_SQL,
    ISO,
    PAGES_SQL,
    PK_SQL,
    POSTS_SQL,
    PROCESSED_SQL,
    RK_SQL,
    RUNS_SQL,
    TRACES_SQL,
)

C = F.col
WINDOW_SQL = f"{AS_OF_SQL} - INTERVAL 24 HOUR"
POST_KEY = "item_pos, link, source_name"
NEWEST_SQL = "published DESC, feed_pos, item_pos"


# --- sources -----------------------------------------------------------------------------


def _config_texts(spark, sf):
    """One registry text per source, with the source in the list of its group."""
    entry = F.struct(
        C("feed_id").alias("sourceName"), "url", "emoji", "category", "active", C("feed_id").alias("notes")
    )
    none = F.array().cast(
        "array<struct<sourceName:string,url:string,emoji:string,category:string,"
        "active:boolean,notes:string>>"
    )

    def listed(group):
        return F.when(C("feed_group") == group, F.array(entry)).otherwise(none)

    lists = F.struct(
        listed("security").alias("securityFeeds"), listed("azureCloud").alias("azureCloudFeeds")
    )
    return v.feeds(spark, sf).select(F.to_json(lists).alias("body"))


@query(
    "s1_feed_registry",
    f"WITH {FEEDS_SQL} SELECT feed_group, feed_id AS source_name, url, emoji, category "
    "FROM feeds WHERE active",
)
def _(spark, sf):
    registry = fds.feed_registry(fds.parse_feed_config(_config_texts(spark, sf)))
    return registry.select("feed_group", "source_name", "url", "emoji", "category")


def _xml_text(c):
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _payloads(posts, body, feed=None):
    """A payload per post, from a feed of its own or from `feed`, a second after the one before."""
    own = F.concat(F.lit("f"), C("item_pos").cast("string"))
    return posts.select(
        (own if feed is None else feed).alias("feed_id"),
        (v.as_of() + F.make_dt_interval(secs=C("item_pos").cast("decimal(18,6)"))).alias("fetched_at"),
        F.when(C("lang") == "de", F.lit(503)).otherwise(200).alias("http_status"),
        F.when(C("lang") == "de", F.lit("HTTP 503")).alias("error"),
        body.alias("body"),
        C("n_chars").alias("elapsed_ms"),
    )


def _rss_body():
    """The post, and a repeat with only an update time, among prefixed tags of other vocabularies."""
    stamp = F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss")
    return F.concat(
        F.lit(
            '<?xml version="1.0"?><rss version="2.0" xmlns:media="m" xmlns:dc="d" xmlns:atom="http://www.w3.org/2005/Atom">'
            "<channel><title>c</title><atom:link href='https://self' rel='self'/><item><media:title>Media</media:title><title>"
        ),
        _xml_text(C("title")),
        F.lit("</title><atom:link href='https://other'/><dc:date>1999-01-01</dc:date><link></link><link>"),
        C("link"),
        F.lit("</link><media:description>MD</media:description><dc:description>DD</dc:description><description>"),
        _xml_text(C("summary")),
        F.lit("</description><pubDate>"),
        stamp,
        F.lit(" GMT</pubDate><category>"),
        C("lang"),
        F.lit("</category><category>x</category></item><item><a10:updated xmlns:a10='a'>"),
        format_iso(C("published")),
        F.lit("</a10:updated></item></channel></rss>"),
    )


def rss_payloads(spark, sf, dated=None):
    return _payloads(v.posts(spark, sf) if dated is None else dated, _rss_body())


def feed_payloads(spark, sf):
    """Many payloads for each source: RSS for even numbers, Atom for odd ones."""
    body = F.when(C("item_pos") % 2 == 0, _rss_body()).otherwise(_atom_body())
    return _payloads(v.posts(spark, sf), body, C("feed_id"))


def _atom_body():
    return F.concat(
        F.lit(
            '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:media="m" xmlns:dc="d"><title>c</title><entry>'
            '<media:title>Media</media:title><title type="text">'
        ),
        _xml_text(C("title")),
        F.lit('</title><media:link href="https://other"/><dc:summary>DS</dc:summary><link rel="alternate" href="'),
        C("link"),
        F.lit('"/><link rel="self" href="x"/><summary type="html">'),
        _xml_text(C("summary")),
        F.lit("</summary><updated>"),
        format_iso(C("published")),
        F.lit('</updated><category term="'),
        C("lang"),
        F.lit('"/></entry></feed>'),
    )


def atom_payloads(spark, sf):
    return _payloads(v.posts(spark, sf), _atom_body())


def _items(parsed):
    return fds.clean_items(parsed).select(
        "feed_id",
        C("item_pos").cast("bigint").alias("item_pos"),
        "title",
        "link",
        F.md5("summary").alias("summary_md5"),
        format_iso(C("published")).alias("published"),
        F.array_join("categories", ",").alias("categories"),
    )


CLEAN_SQL = trim(decode("regexp_replace(summary, '<[^\\n]*?>', '', 'g')"))
ITEM_SQL = f"""SELECT 'f' || item_pos AS feed_id, 0::BIGINT AS item_pos, {trim("title")} AS title, link,
  md5({CLEAN_SQL}) AS summary_md5, strftime(published, {ISO}) AS published,"""


@query(
    "s2_parse_rss",
    f"""WITH {POSTS_SQL} {ITEM_SQL} lang || ',x' AS categories FROM posts WHERE lang <> 'de'
UNION ALL SELECT 'f' || item_pos, 1, 'No title', '', md5(''), strftime(published, {ISO}), ''
FROM posts WHERE lang <> 'de'""",
)
def _(spark, sf):
    return _items(fds.parse_rss(rss_payloads(spark, sf)))


@query("s3_parse_atom", f"WITH {POSTS_SQL} {ITEM_SQL} lang AS categories FROM posts WHERE lang <> 'de'")
def _(spark, sf):
    return _items(fds.parse_atom(atom_payloads(spark, sf)))


@query(
    "s2_payload_outcomes",
    f"""WITH {POSTS_SQL} SELECT 'f' || item_pos AS feed_id, CASE lang WHEN 'de' THEN 'HTTP 503'
  WHEN 'es' THEN 'HTML instead of XML' WHEN 'fr' THEN 'Not XML format' END AS error FROM posts""",
)
def _(spark, sf):
    """Feed answers of which some failed, some are html and some no feed."""
    body = (
        F.when(C("lang") == "es", F.concat(F.lit("<HTML>"), C("body")))
        .when(C("lang") == "fr", C("title"))
        .otherwise(C("body"))
    )
    posts = v.posts(spark, sf).select(
        F.concat(F.lit("f"), C("item_pos").cast("string")).alias("feed_id"), "lang", "title"
    )
    answers = rss_payloads(spark, sf).join(posts, "feed_id").withColumn("body", body)
    return fds.payload_outcomes(answers).select("feed_id", "error")


@query(
    "s4_load_pages",
    f"WITH {PAGES_SQL} SELECT lower(url) AS url, min(md5(html)) AS html_md5, "
    "arg_min(length(html), md5(html)) AS n_chars FROM fetched "
    "WHERE status BETWEEN 200 AND 299 AND contains(lower(content_type), 'html') GROUP BY 1",
)
def _(spark, sf):
    n = F.char_length("html").cast("bigint")
    return tbs.load_pages(v.pages(spark, sf), html_md5=F.md5("html"), n_chars=n)


@query(
    "s5_read_processed",
    f"WITH {PROCESSED_SQL} SELECT pk, rk, link, array_to_string(english_list, ',') AS english, "
    "array_to_string(korean_list, ',') AS korean, "
    f"strftime(coalesce(processed_date, ts), {ISO}) AS processed_time FROM processed",
)
def _(spark, sf):
    return stt.read_processed(v.processed(spark, sf)).select(
        "pk",
        "rk",
        "link",
        F.array_join("english_summary", ",").alias("english"),
        F.array_join("korean_summary", ",").alias("korean"),
        format_iso(C("processed_time")).alias("processed_time"),
    )


MIXED_SQL = f"""WITH {PROCESSED_SQL},
parts AS (
  SELECT {PK_SQL} AS pk, {RK_SQL} AS rk, title, link, source_name, published, item_pos % 4 AS part FROM posts),
turns AS (
  SELECT pk, rk, title, link, source_name, processed_date, 0 AS turn FROM processed
  UNION ALL SELECT pk, rk, title, link, source_name, {AS_OF_SQL} + INTERVAL 1 DAY * part, 1 + part::INT FROM parts),
state AS (
  SELECT * FROM turns QUALIFY row_number() OVER (
    PARTITION BY pk, rk ORDER BY turn DESC, processed_date DESC NULLS LAST, link, title) = 1)
SELECT pk, rk, title, link, source_name, strftime(processed_date, {ISO}) AS processed_date FROM state"""


@query("s6_upsert_mixed_writers", MIXED_SQL)
def _(spark, sf):
    """Batch appends, a stream, a snapshot, the stream again and a restarted one on one table.

    Each of the four parts of the posts is written in turn; the stream begins anew after two, so its batch
    numbers repeat those of the batch job and of itself.
    """
    state = stt.ProcessedPosts(spark, shared_dir(spark, "state"))
    dated = v.settled_posts(spark, sf)
    state.append(v.processed(spark, sf, dated), 0)
    none = F.array().cast("array<string>")

    def part(n):
        posts = dated.filter(C("item_pos") % 4 == n)
        full = posts.withColumns({"english_summary": none, "korean_summary": none})
        return stt.to_state_rows(full, F.expr(f"{AS_OF_SQL} + INTERVAL {n} DAYS"))

    def stream(writer, numbers):
        path = shared_dir(spark, "posts")
        for n in numbers:
            part(n).write.mode("append").option("compression", "zstd").parquet(path)
            rows = stm.payload_stream(spark, path, part(0).schema)
            stm.run_batches(rows, stm.upsert_batch(state, writer), f"{path}-check")

    stream("first", [0, 1])
    state.snapshot()
    state.append(part(0), 0)  # folded by now, so nothing happens
    stream("second", [2])
    state.append(part(3), 1)
    state.append(part(3), 1)
    return state.rows().select(
        "pk", "rk", "title", "link", "source_name", format_iso(C("processed_date")).alias("processed_date")
    )


@query(
    "s6_versions_out_of_order",
    f"""WITH {PROCESSED_SQL},
parts AS (
  SELECT {PK_SQL} AS pk, {RK_SQL} AS rk, title, link, source_name, published,
    list_position([2, 0, 3, 1], item_pos % 4) AS part FROM posts),
turns AS (
  SELECT pk, rk, title, link, source_name, processed_date, publish_date, ts, 0 AS turn FROM processed
  UNION ALL SELECT pk, rk, title, link, source_name, {AS_OF_SQL}, strftime(published, {ISO}), {AS_OF_SQL}, part::INT FROM parts),
state AS (
  SELECT * FROM turns QUALIFY row_number() OVER (
    PARTITION BY pk, rk ORDER BY turn DESC, processed_date DESC NULLS LAST, link, title, publish_date, ts) = 1)
SELECT pk, rk, title, link, source_name, publish_date FROM state""",
)
def _(spark, sf):
    """A backfill: versions are written as 0, 5, 3 and 4 with snapshots between, and some of them again."""
    state = stt.ProcessedPosts(spark, shared_dir(spark, "state"))
    dated = v.settled_posts(spark, sf)
    state.append(v.processed(spark, sf, dated), 0)
    none = F.array().cast("array<string>")

    def append(part, version, writer="batch"):
        posts = dated.filter(C("item_pos") % 4 == part)
        full = posts.withColumns({"english_summary": none, "korean_summary": none})
        state.append(stt.to_state_rows(full, v.as_of()), version, writer)

    append(2, 5)
    state.snapshot()
    append(0, 3)
    append(2, 5)  # folded by now, so nothing happens
    state.snapshot()
    state.clean_up()
    append(3, 4)
    append(1, 3, "other")
    append(3, 4)  # keeps its turn
    return state.rows().select("pk", "rk", "title", "link", "source_name", "publish_date")


UPSERT_SQL = f"""WITH {PROCESSED_SQL},
fresh AS (
  SELECT pk, rk, link, source_name, {AS_OF_SQL} AS processed_date FROM (
    SELECT {PK_SQL} AS pk, {RK_SQL} AS rk, link, source_name FROM posts
    WHERE published >= {WINDOW_SQL})),
merged AS (
  SELECT pk, rk, link, source_name, processed_date, 0 AS version FROM processed
  UNION ALL SELECT pk, rk, link, source_name, processed_date, 1 FROM fresh),
state AS (
  SELECT * FROM merged QUALIFY row_number() OVER (
    PARTITION BY pk, rk ORDER BY version DESC, processed_date DESC NULLS LAST) = 1)
SELECT pk, rk, link, source_name, strftime(processed_date, {ISO}) AS processed_date FROM state"""


def _fresh_rows(posts):
    bullets = F.array("title")
    fresh = flt.new_window_filter(posts, v.as_of(), 24).withColumns(
        {"english_summary": bullets, "korean_summary": bullets}
    )
    return stt.to_state_rows(fresh, v.as_of())


def _state_view(rows):
    return rows.select(
        "pk", "rk", "link", "source_name", format_iso(C("processed_date")).alias("processed_date")
    )


@query("s6_upsert_processed", UPSERT_SQL)
def _(spark, sf):
    old = stt.latest_per_key(v.processed(spark, sf), C("processed_date").desc())
    return _state_view(stt.upsert_processed(old, _fresh_rows(v.posts(spark, sf))))


@query("s6_upsert_processed_stored", UPSERT_SQL)
def _(spark, sf):
    """The same through the stored table: two versions, a replay and a snapshot."""
    state = stt.ProcessedPosts(spark, shared_dir(spark, "state"))
    dated = v.settled_posts(spark, sf)
    state.append(v.processed(spark, sf, dated), 0)
    state.snapshot()
    state.append(_fresh_rows(dated), 1)
    state.append(_fresh_rows(dated), 1)
    return _state_view(state.rows())


@query(
    "s7_sample_items",
    f"""WITH {POSTS_SQL}, {RUNS_SQL}
SELECT digest_id, n::BIGINT AS item_pos, 'https://www.microsoft.com/security/blog/test-' || (n + 1)
    AS link, strftime(as_of - INTERVAL 1 HOUR * (2 + 3 * n), {ISO}) AS published
FROM runs, (VALUES (0), (1), (2)) t(n)""",
)
def _(spark, sf):
    return fds.sample_items(v.runs(spark, sf)).select(
        "digest_id",
        C("item_pos").cast("bigint").alias("item_pos"),
        "link",
        format_iso(C("published")).alias("published"),
    )


@query(
    "s9_schedule_ticks",
    f"""WITH span AS (
  SELECT min(ts)::DATE AS first_day, max(ts)::DATE AS last_day FROM events),
days AS (SELECT unnest(generate_series(first_day::TIMESTAMP, last_day, INTERVAL 1 DAY)) AS day
  FROM span),
hours AS (SELECT * FROM (VALUES ('security', 7), ('security', 19), ('azureCloud', 8),
  ('azureCloud', 20)) t(feed_group, hour))
SELECT feed_group, hour::BIGINT AS hour,
  strftime(day + INTERVAL 1 HOUR * hour - INTERVAL 9 HOUR, {ISO}) AS tick
FROM days, hours""",
)
def _(spark, sf):
    ticks = tbs.schedule_ticks(_schedule_spans(spark, sf))
    return ticks.select(
        "feed_group", C("hour").cast("bigint").alias("hour"), format_iso(C("tick")).alias("tick")
    )


# Local hours of the daily runs per feed group.
SCHEDULE = {"security": [7, 19], "azureCloud": [8, 20]}


def _schedule_spans(spark, sf):
    """The schedule over all days the events span."""
    span = v.events(spark, sf).agg(
        F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day")
    )
    plan = F.array(
        *[
            F.struct(F.lit(g).alias("feed_group"), F.array(*[F.lit(h) for h in hours]).alias("hours"))
            for g, hours in SCHEDULE.items()
        ]
    )
    listed = span.select("first_day", "last_day", F.explode(plan).alias("s"))
    return listed.select(
        "s.feed_group", "s.hours", F.lit("Asia/Seoul").alias("tz"), "first_day", "last_day"
    )


@query(
    "s10_load_telemetry",
    f"SELECT event_type AS name, count(*) AS n FROM events WHERE ts >= {WINDOW_SQL} GROUP BY 1",
)
def _(spark, sf):
    rows = tbs.load_telemetry(v.requests(spark, sf), F.expr(f"{AS_OF_SQL} - INTERVAL 24 HOURS"))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def _by_day(spark, rows, schema: str):
    """Telemetry written by day in two batches, one of them twice, and read back."""
    path = shared_dir(spark, "telemetry")
    odd = F.hour("ts") % 2 == 1
    for batch, part in (("even", ~odd), ("odd", odd), ("even", ~odd)):
        tbs.write_telemetry(rows.filter(part), path, batch)
    return tbs.read_telemetry(spark, path, schema)


def _requests_by_day(spark, sf):
    return _by_day(spark, v.requests(spark, sf), "ts TIMESTAMP, name STRING, duration DOUBLE")


@query("s10_load_telemetry_by_day", SQL["s10_load_telemetry"])
def _(spark, sf):
    rows = tbs.load_telemetry(_requests_by_day(spark, sf), F.expr(f"{AS_OF_SQL} - INTERVAL 24 HOURS"))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


# --- filters and projections -------------------------------------------------------------


@query(
    "f1_recency_filter",
    f"WITH {POSTS_SQL} SELECT {POST_KEY} FROM posts WHERE published >= {AS_OF_SQL} - INTERVAL 2 DAY",
)
def _(spark, sf):
    return flt.recency_filter(v.posts(spark, sf), v.as_of(), 2).select("item_pos", "link", "source_name")


@query(
    "f2_new_window_filter",
    f"WITH {POSTS_SQL} SELECT {POST_KEY} FROM posts WHERE published >= {WINDOW_SQL}",
)
def _(spark, sf):
    return flt.new_window_filter(v.posts(spark, sf), v.as_of(), 24).select(
        "item_pos", "link", "source_name"
    )


@query(
    "f3_published_fallback",
    f"""SELECT event_id, strftime(CASE WHEN event_type = 'error' OR event_type = 'click'
  THEN ts + INTERVAL 1 DAY ELSE ts END, {ISO}) AS published FROM events""",
)
def _(spark, sf):
    kind = C("event_type")
    given = F.when(kind == "click", F.expr("ts - INTERVAL 30 YEARS")).when(kind != "error", C("ts"))
    chosen = published_or_updated(given, F.expr("ts + INTERVAL 1 DAY"))
    return v.events(spark, sf).select("event_id", format_iso(chosen).alias("published"))


def _patchy(spark, sf):
    """Posts of which some lack a link, a title or a source name."""
    return v.documents(spark, sf).withColumns(
        {
            "link": F.when(C("lang") == "fr", F.lit("  ")).otherwise(C("link")),
            "title": F.when(C("lang") != "es", C("title")),
            "source_name": F.when(C("lang") == "de", F.lit("  "))
            .when(C("lang") == "es", F.lit(None))
            .otherwise(C("source_name")),
        }
    )


PATCHY_SQL = f"""{DOCUMENTS_SQL},
patchy AS (
  SELECT * REPLACE (
    CASE WHEN lang = 'fr' THEN ' ' || chr(160) ELSE link END AS link,
    CASE WHEN lang <> 'es' THEN title END AS title,
    CASE WHEN lang = 'de' THEN '  ' WHEN lang = 'es' THEN NULL ELSE source_name END AS source_name)
  FROM docs)"""


@query(
    "f4_nonblank_link",
    f"WITH {PATCHY_SQL} SELECT item_pos, link FROM patchy WHERE lang <> 'fr'",
)
def _(spark, sf):
    return flt.nonblank_link(_patchy(spark, sf)).select("item_pos", "link")


@query(
    "f5_clamp_params",
    f"""WITH r AS (
  SELECT event_id, user_id - 40 AS d, CAST(floor(value) AS INT) - 5 AS m, user_id * 3 - 50 AS w,
    CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN '  '
      ELSE '  at ' || event_type || ' ' END AS t FROM events)
SELECT event_id, CASE WHEN d > 0 THEN d ELSE 30 END AS days_since,
  CASE WHEN m > 0 THEN CAST(least(m, 30) AS BIGINT) ELSE 12 END AS max_items,
  CASE WHEN w > 0 THEN least(w, 168) ELSE 24 END AS new_window_hours,
  CASE WHEN coalesce(trim(t), '') = '' THEN {quoted(DEFAULT_SCHEDULE_TEXT)} ELSE trim(t) END
    AS schedule_text FROM r""",
)
def _(spark, sf):
    kind = C("event_type")
    asked = v.events(spark, sf).select(
        "event_id",
        (C("user_id") - 40).alias("days_since"),
        (F.floor("value") - 5).alias("max_items"),
        (C("user_id") * 3 - 50).alias("new_window_hours"),
        F.when(kind == "view", "  ")
        .when(kind != "error", F.concat(F.lit("  at "), kind, F.lit(" ")))
        .alias("schedule_text"),
    )
    return flt.clamp_params(asked)


@query(
    "f6_valid_feeds",
    f"WITH {FEEDS_SQL} SELECT feed_id, url FROM feeds WHERE trim(url) <> ''",
)
def _(spark, sf):
    return flt.valid_feeds(v.feeds(spark, sf)).select("feed_id", "url")


@query(
    "f6_rejected_runs",
    f"""WITH {POSTS_SQL}, {RUNS_SQL}, {FEEDS_SQL}
SELECT digest_id FROM runs WHERE feed_group NOT IN (
  SELECT feed_group FROM feeds WHERE active AND feed_group = 'security')""",
)
def _(spark, sf):
    listed = v.feeds(spark, sf).filter("active AND feed_group = 'security'")
    return flt.rejected_runs(v.runs(spark, sf), listed).select("digest_id")


@query(
    "f7_source_default",
    f"""WITH {PATCHY_SQL} SELECT item_pos,
  CASE WHEN coalesce(trim(source_name), '') = '' THEN 'Unknown' ELSE source_name END AS post_source,
  coalesce(source_name, 'Unknown') AS status_source FROM patchy""",
)
def _(spark, sf):
    return _patchy(spark, sf).select(
        "item_pos",
        fds.source_default(C("source_name")).alias("post_source"),
        fds.status_source_default(C("source_name")).alias("status_source"),
    )


@query(
    "f8_title_default",
    f"WITH {PATCHY_SQL} SELECT item_pos, coalesce(title, 'No title') AS title FROM patchy",
)
def _(spark, sf):
    return _patchy(spark, sf).select("item_pos", fds.title_default(C("title")).alias("title"))


@query(
    "f9_first_link",
    f"WITH {DOCUMENTS_SQL} SELECT item_pos, CASE WHEN lang = 'fr' THEN '' ELSE link END AS link FROM docs",
)
def _(spark, sf):
    links = F.when(C("lang") == "de", F.array("link")).when(
        C("lang") != "fr", F.array("link", "source_name")
    )
    return v.documents(spark, sf).select("item_pos", fds.first_link(links).alias("link"))


PAYLOAD_KIND_SQL = """
bodies AS (
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN html
    WHEN 1 THEN '  <?xml version="1.0"?><rss><item>' || url || '</item><item></item></rss>' || html
    WHEN 2 THEN '<feed><entry></entry><ENTRY/></feed>' WHEN 3 THEN url || '<RSS><item>' ELSE url END
    AS body, CASE WHEN page_id % 7 = 3 THEN 403 ELSE 200 END AS http_status
  FROM pages),
kinds AS (
  SELECT *, CASE WHEN starts_with(ltrim(lower(body)), '<!doctype html') THEN 'html'
    WHEN starts_with(ltrim(lower(body)), '<?xml') OR contains(left(ltrim(lower(body)), 200), '<rss')
      THEN 'xml' ELSE 'other' END AS kind,
    len(regexp_extract_all(body, '<item>|<entry>')) AS entries FROM bodies)"""


def page_payloads(spark, sf):
    """Page rows as feed answers: html pages, RSS, Atom without a declaration, plain text."""
    n, url = C("page_id") % 5, C("url")
    rss = F.concat(
        F.lit('  <?xml version="1.0"?><rss><item>'), url, F.lit("</item><item></item></rss>"), C("html")
    )
    body = (
        F.when(n == 0, C("html"))
        .when(n == 1, rss)
        .when(n == 2, F.lit("<feed><entry></entry><ENTRY/></feed>"))
        .when(n == 3, F.concat(url, F.lit("<RSS><item>")))
        .otherwise(url)
    )
    return v.table(spark, sf, "pages").select(
        C("page_id").alias("feed_id"),
        body.alias("body"),
        F.when(C("page_id") % 7 == 3, 403).otherwise(200).alias("http_status"),
        F.lit(None).cast("string").alias("error"),
    )


@query(
    "f10_classify_payload",
    f"WITH {PAYLOAD_KIND_SQL} SELECT page_id AS feed_id, kind, entries FROM kinds",
)
def _(spark, sf):
    return sts.payload_report(page_payloads(spark, sf)).select("feed_id", "kind", "entries")


def _with_placeholders(spark, sf):
    """Posts of which some are placeholders by title or by summary."""
    lang = C("lang")
    return v.documents(spark, sf).withColumns(
        {
            "title": F.when(lang == "fr", PLACEHOLDER_TITLES[1])
            .when(lang == "es", F.lit(None))
            .otherwise(C("title")),
            "summary": F.when(lang == "de", PLACEHOLDER_SUMMARY).otherwise(C("summary")),
            "digest_id": C("source_name"),
        }
    )


@query(
    "f11_placeholder_filter",
    f"WITH {DOCUMENTS_SQL} SELECT item_pos FROM docs WHERE lang NOT IN ('fr', 'de')",
)
def _(spark, sf):
    rows = _with_placeholders(spark, sf)
    return rows.filter(~flt.is_placeholder(C("title"), C("summary"))).select("item_pos")


@query(
    "f12_required_fields",
    f"WITH {PATCHY_SQL} SELECT item_pos, lang <> 'es' AS accepted FROM patchy",
)
def _(spark, sf):
    good, bad = flt.required_fields(_patchy(spark, sf))
    return rws.union_feeds(
        [
            good.select("item_pos", F.lit(True).alias("accepted")),
            bad.select("item_pos", F.lit(False).alias("accepted")),
        ]
    )


@query(
    "f13_summary_points",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 3
  WHEN user_id BETWEEN 1 AND 10 THEN user_id ELSE 3 END::BIGINT AS points FROM events""",
)
def _(spark, sf):
    raw = F.when(C("event_type") == "click", "many").otherwise(
        F.concat(F.lit(" "), C("user_id").cast("string"))
    )
    return v.events(spark, sf).select(
        "event_id", flt.summary_points(raw).cast("bigint").alias("points")
    )


@query(
    "f14_empty_content_default",
    f"""WITH {PATCHY_SQL} SELECT item_pos,
  CASE WHEN lang = 'es' OR coalesce(title, '') = '' OR summary = '' THEN {quoted(EMPTY_EN)} END AS en,
  CASE WHEN lang = 'es' OR coalesce(title, '') = '' OR summary = '' THEN {quoted(EMPTY_KO)} END AS ko
FROM patchy""",
)
def _(spark, sf):
    pair = flt.empty_content_summary(C("title"), C("summary"))
    rows = _patchy(spark, sf).select("item_pos", pair.alias("p"))
    return rows.select(
        "item_pos",
        F.array_join("p.english_summary", ",").alias("en"),
        F.array_join("p.korean_summary", ",").alias("ko"),
    )


# --- joins -------------------------------------------------------------------------------


@query(
    "j1_check_duplicate",
    f"""WITH {PROCESSED_SQL}, k AS (SELECT DISTINCT pk, rk FROM processed)
SELECT item_pos, k.pk IS NOT NULL AS is_duplicate
FROM (SELECT *, {PK_SQL} AS pk, {RK_SQL} AS rk FROM posts) p LEFT JOIN k USING (pk, rk)""",
)
def _(spark, sf):
    flagged = pst.check_duplicate(v.posts(spark, sf), v.state_keys(spark, sf))
    return flagged.select("item_pos", "is_duplicate")


@query(
    "j2_unprocessed_posts",
    f"""WITH {PROCESSED_SQL}
SELECT item_pos, link FROM (SELECT *, {PK_SQL} AS pk, {RK_SQL} AS rk FROM posts) p
WHERE NOT EXISTS (SELECT 1 FROM processed s WHERE s.pk = p.pk AND s.rk = p.rk)""",
)
def _(spark, sf):
    left = pst.unprocessed_posts(v.posts(spark, sf), v.state_keys(spark, sf))
    return left.select("item_pos", "link")


def _stored(spark, sf, shift: str = "INTERVAL 0 DAYS"):
    """The state table in its folder: all rows, folded, and the recent ones once more as a later version."""
    rows = v.processed(spark, sf).withColumn("ts", F.expr(f"ts - {shift}"))
    state = stt.ProcessedPosts(spark, shared_dir(spark, "state"))
    state.append(rows, 0)
    state.snapshot()
    state.append(rows.filter(C("ts") >= F.expr(f"{AS_OF_SQL} - INTERVAL 12 HOURS")), 1)
    return state


@query("j1_check_duplicate_stored", SQL["j1_check_duplicate"])
def _(spark, sf):
    """Posts against the stored keys, of which only the buckets of the posts are read."""
    posts = v.posts(spark, sf)
    return pst.check_duplicate(posts, _stored(spark, sf).seen(posts)).select("item_pos", "is_duplicate")


@query("j2_unprocessed_posts_stored", SQL["j2_unprocessed_posts"])
def _(spark, sf):
    posts = v.posts(spark, sf)
    return pst.unprocessed_posts(posts, _stored(spark, sf).seen(posts)).select("item_pos", "link")


def _page_posts(spark, sf):
    """Pages as posts with their address as link; those that failed have a blank link."""
    link = F.when(F.contains("url", F.lit("#")), " ").otherwise(F.regexp_replace("url", "[?#].*$", ""))
    return v.table(spark, sf, "pages").select(C("page_id").alias("item_pos"), link.alias("link"))


@query(
    "j3_enrich_pages",
    f"""WITH {PAGES_SQL}, p AS (
  SELECT lower(url) AS k, min(md5(html)) AS html_md5 FROM fetched WHERE status BETWEEN 200 AND 299
    AND contains(lower(content_type), 'html') GROUP BY 1),
d AS (SELECT page_id AS item_pos, CASE WHEN contains(url, '#') THEN ' '
  ELSE regexp_replace(url, '[?#].*$', '') END AS link FROM pages)
SELECT item_pos, link, html_md5 FROM d LEFT JOIN p ON lower(link) = k""",
)
def _(spark, sf):
    posts = _page_posts(spark, sf)
    found = tbs.load_pages(v.pages(spark, sf), links=posts, html_md5=F.md5("html"))
    return rws.enrich_pages(posts, found).select("item_pos", "link", "html_md5")


@query(
    "j4_items_to_feeds",
    f"""WITH {POSTS_SQL}, {FEEDS_SQL}
SELECT p.item_pos, CASE WHEN coalesce(trim(f.source_name), '') = '' THEN 'Unknown'
  ELSE f.source_name END AS source_name, f.emoji, f.feed_group
FROM posts p JOIN feeds f USING (feed_id)""",
)
def _(spark, sf):
    items = v.posts(spark, sf).select("feed_id", "item_pos", "link", "published")
    joined = fds.items_to_feeds(items, v.feeds(spark, sf))
    return joined.select("item_pos", "source_name", "emoji", "feed_group")


def _emoji_case(map_name: str) -> str:
    cases = " ".join(
        f"WHEN {quoted(k)} THEN {quoted(e)}" for k, e in EMOJI_MAPS[map_name].items()
    )
    return f"CASE name {cases} ELSE {quoted(DEFAULT_EMOJI)} END"


_BLOGS = ["Azure DevOps Blog", "Microsoft Sentinel Blog", "Sentinel Blog", "Power Platform", "Other"]


@query(
    "j5_source_emoji",
    f"""WITH n AS (SELECT event_id, [{", ".join(quoted(b) for b in _BLOGS)}][(user_id % 5)::INT + 1]
  AS name FROM events)
SELECT event_id, {_emoji_case("recent")} AS recent, {_emoji_case("mail")} AS mail FROM n""",
)
def _(spark, sf):
    name = F.element_at(F.array(*[F.lit(b) for b in _BLOGS]), (C("user_id") % 5 + 1).cast("int"))
    return v.events(spark, sf).select(
        "event_id",
        source_emoji(name, "recent").alias("recent"),
        source_emoji(name, "mail").alias("mail"),
    )


TICKS_SQL = f"""WITH {POSTS_SQL}, {RUNS_SQL}
SELECT r.digest_id, p.item_pos FROM runs r JOIN posts p ON r.feed_group = p.feed_group"""


@query(
    "j8_ticks_to_items",
    f"{TICKS_SQL} AND p.published >= r.as_of - INTERVAL 1 HOUR * r.new_window_hours AND p.published <= r.as_of",
)
def _(spark, sf):
    seen = pst.runs_to_items(flt.clamp_params(v.runs(spark, sf)), v.posts(spark, sf).drop("title", "summary"))
    return seen.select("digest_id", "item_pos")


@query(
    "j8_open_runs_to_items",
    f"WITH {POSTS_SQL} SELECT feed_group, item_pos FROM posts WHERE published >= {WINDOW_SQL}",
)
def _(spark, sf):
    """The open form is a live request: one `as_of`, and later items count as well."""
    return pst.live_items(v.posts(spark, sf), v.as_of(), 24).select("feed_group", "item_pos")


# --- aggregates --------------------------------------------------------------------------


def _positioned(rows):
    return rows.withColumn("position", C("position").cast("bigint"))


STATES_SQL = f"""
seen AS (
  SELECT r.digest_id, p.feed_id, p.published >= r.as_of - INTERVAL 1 HOUR * {HOURS_SQL} AS is_new
  FROM runs r JOIN posts p ON r.feed_group = p.feed_group
    AND p.published >= r.as_of - INTERVAL 1 DAY * r.days_since AND p.published <= r.as_of),
counts AS (
  SELECT digest_id, feed_id, count(*) AS items, count(*) FILTER (is_new) AS items_new
  FROM seen GROUP BY ALL),
statuses AS (
  SELECT r.digest_id, f.feed_id, f.feed_pos, coalesce(f.source_name, 'Unknown') AS source_name, f.url,
    f.feed_pos <> 7 AS ok, f.feed_pos * 10 AS elapsed_ms,
    CASE WHEN f.feed_pos = 7 THEN 0 ELSE coalesce(c.items, 0) END AS items,
    CASE WHEN f.feed_pos = 7 THEN 0 ELSE coalesce(c.items_new, 0) END AS items_new,
    CASE WHEN f.feed_pos = 7 THEN 'HTTP 503' END AS error
  FROM runs r JOIN feeds f USING (feed_group) LEFT JOIN counts c USING (digest_id, feed_id))"""
STATUS_SQL = f"{POSTS_SQL}, {RUNS_SQL}, {FEEDS_SQL}, {STATES_SQL}"


def run_feeds(spark, sf, runs=None):
    """The feeds of each run; one of them fails."""
    failed = F.when(C("feed_pos") == 7, F.lit("HTTP 503"))
    asked = (v.runs(spark, sf) if runs is None else runs).select("digest_id", "feed_group", "as_of", "days_since", "new_window_hours")
    return (
        v.feeds(spark, sf)
        .join(asked, "feed_group")
        .withColumns({"error": failed, "elapsed_ms": (C("feed_pos") * 10).cast("bigint")})
    )


def run_statuses(spark, sf, runs=None):
    listed = run_feeds(spark, sf, runs)
    narrow = v.posts(spark, sf).select("feed_group", "feed_id", "published")
    return sts.status_from_counts(listed, counts_per_feed(listed, narrow))


@query(
    "a1_feed_status",
    f"WITH {STATUS_SQL} SELECT digest_id, feed_id, source_name, ok, items, items_new, error FROM statuses",
)
def _(spark, sf):
    return run_statuses(spark, sf).select(
        "digest_id", "feed_id", "source_name", "ok", "items", "items_new", "error"
    )


@query(
    "a1_feed_counts_by_running_total",
    f"""WITH {POSTS_SQL}, {RUNS_SQL}, {FEEDS_SQL}
SELECT r.digest_id, f.feed_id,
  count(p.item_pos) FILTER (p.published >= r.as_of - INTERVAL 2 DAY) AS items,
  count(p.item_pos) FILTER (p.published >= r.as_of - INTERVAL 1 HOUR * least(48, r.new_window_hours)) AS items_new
FROM runs r JOIN feeds f USING (feed_group)
  LEFT JOIN posts p ON p.feed_id = f.feed_id AND p.published <= r.as_of GROUP BY 1, 2""",
)
def _(spark, sf):
    listed = run_feeds(spark, sf).withColumn("days_since", F.lit(2))
    return counts_per_feed(listed, v.posts(spark, sf).select("feed_group", "feed_id", "published"))


CHOICE_TAIL_SQL = f"""
recent AS (
  SELECT r.digest_id, r.as_of, r.max_items, p.* FROM runs r JOIN posts p
  ON r.feed_group = p.feed_group AND p.published >= r.as_of - INTERVAL 1 HOUR * {HOURS_SQL}
    AND p.published <= r.as_of
  QUALIFY row_number() OVER (PARTITION BY r.digest_id, upper(p.link)
    ORDER BY p.published DESC, p.feed_pos, p.item_pos) = 1),
fresh AS (
  SELECT * FROM recent q WHERE NOT EXISTS (
    SELECT 1 FROM processed s WHERE s.pk = {PK_SQL.replace("source_name", "q.source_name")}
      AND s.rk = {RK_SQL.replace("link", "q.link")})),
new_posts AS (
  SELECT *, row_number() OVER (PARTITION BY digest_id ORDER BY {NEWEST_SQL}) AS rank FROM fresh
  QUALIFY rank <= max_items),
shown AS (
  SELECT digest_id, item_pos, rank, true AS is_new_post, published, as_of FROM new_posts
  UNION ALL
  SELECT digest_id, item_pos, rank, false, published, as_of FROM (
    SELECT *, row_number() OVER (PARTITION BY digest_id ORDER BY {NEWEST_SQL}) AS rank FROM recent
    QUALIFY rank <= 10) WHERE digest_id NOT IN (SELECT digest_id FROM new_posts))"""
CHOICE_SQL = f"{PROCESSED_SQL}, {RUNS_SQL},{CHOICE_TAIL_SQL}"


ALL_ITEMS_SQL = """(SELECT count(DISTINCT upper(link)) FROM posts x WHERE x.feed_group = r.feed_group
    AND x.published >= r.as_of - INTERVAL 1 DAY * r.days_since AND x.published <= r.as_of)"""


def choice(spark, sf):
    """Runs, items and state keys are stored tables to the digest, so the views of them are settled first."""
    items = settle(v.posts(spark, sf).drop("title", "summary"), "items")
    runs, keys = settle(v.runs(spark, sf), "runs"), settle(v.state_keys(spark, sf), "keys")
    return choose_posts(runs, items, keys)


@query(
    "a2_digest_counts",
    f"""WITH {CHOICE_SQL}
SELECT r.digest_id,
  {ALL_ITEMS_SQL} AS all_items,
  (SELECT count(*) FROM new_posts x WHERE x.digest_id = r.digest_id) AS new_posts,
  (SELECT count(*) FROM shown x WHERE x.digest_id = r.digest_id) AS display_posts,
  (SELECT count(*) FROM shown x WHERE x.digest_id = r.digest_id
    AND x.published >= r.as_of - INTERVAL 1 HOUR * r.new_window_hours) AS recent_posts
FROM runs r""",
)
def _(spark, sf):
    c = choice(spark, sf)
    return sts.digest_counts(c.links, c.shown, c.runs)


@query(
    "a3_actual_new_count",
    f"""WITH {DOCUMENTS_SQL} SELECT source_name AS digest_id,
  count(*) FILTER (lang NOT IN ('fr', 'de')) AS actual_new, count(*) AS shown FROM docs GROUP BY 1""",
)
def _(spark, sf):
    return sts.actual_new_count(_with_placeholders(spark, sf))


@query(
    "a5_payload_summary",
    f"""WITH {PAYLOAD_KIND_SQL}
SELECT http_status = 200 AND kind = 'xml' AS valid,
  CASE WHEN http_status <> 200 THEN 'HTTP 403' WHEN kind = 'html' THEN 'HTML instead of XML'
    WHEN kind = 'other' THEN 'Not XML format' ELSE 'OK' END AS reason,
  count(*) AS payloads, sum(entries)::BIGINT AS entries FROM kinds GROUP BY 1, 2""",
)
def _(spark, sf):
    return sts.payload_summary(page_payloads(spark, sf))


@query(
    "a6_errors_by_role",
    f"""WITH {TRACES_SQL} SELECT role, severity::BIGINT AS severity, count(*) AS n FROM traces
WHERE ts > {WINDOW_SQL} AND severity >= 3 GROUP BY 1, 2""",
)
def _(spark, sf):
    found = sts.errors_by_role(v.traces(spark, sf), v.as_of())
    return found.withColumn("severity", C("severity").cast("bigint"))


@query("a6_errors_by_role_by_day", SQL["a6_errors_by_role"])
def _(spark, sf):
    schema = "ts TIMESTAMP, severity INT, message STRING, role STRING, dims MAP<STRING, STRING>"
    found = sts.errors_by_role(_by_day(spark, v.traces(spark, sf), schema), v.as_of())
    return found.withColumn("severity", C("severity").cast("bigint"))


LATENCY_SQL = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') AS hour,
  sum(value::DECIMAL(20, 6))::DOUBLE / count(value) AS avg_duration, max(value) AS max_duration, count(*) AS n
FROM events WHERE event_type = 'purchase' {more} GROUP BY 1"""


def _latency(found):
    return found.select(
        format_iso(C("hour")).alias("hour"),
        "avg_duration",
        "max_duration",
        "n",
    )


@query(
    "a7_request_latency_hourly",
    LATENCY_SQL.format(more=f"AND ts > {AS_OF_SQL} - INTERVAL 7 DAY"),
)
def _(spark, sf):
    return _latency(sts.request_latency_hourly(v.requests(spark, sf), "purchase", v.as_of()))


@query("a7_request_latency_hourly_by_day", SQL["a7_request_latency_hourly"])
def _(spark, sf):
    return _latency(sts.request_latency_hourly(_requests_by_day(spark, sf), "purchase", v.as_of()))


@query("a7_request_latency_all_time", LATENCY_SQL.format(more=""))
def _(spark, sf):
    return _latency(sts.request_latency_hourly(v.requests(spark, sf), "purchase"))


@query(
    "a8_feed_failure_counts",
    f"""WITH {TRACES_SQL} SELECT url, count(*) AS n FROM traces
WHERE contains(lower(message), 'feed fetch failed') GROUP BY 1""",
)
def _(spark, sf):
    return sts.feed_failure_counts(v.traces(spark, sf))


@query(
    "a9_calls_by_name",
    f"""SELECT event_type AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS position
FROM events WHERE ts > {AS_OF_SQL} - INTERVAL 1 HOUR GROUP BY 1""",
)
def _(spark, sf):
    return _positioned(sts.calls_by_name(v.requests(spark, sf), v.as_of()))


@query("a9_calls_by_name_by_day", SQL["a9_calls_by_name"])
def _(spark, sf):
    return _positioned(sts.calls_by_name(_requests_by_day(spark, sf), v.as_of()))


# --- ranking -----------------------------------------------------------------------------


@query(
    "w1_dedup_by_link",
    f"""WITH {POSTS_SQL} SELECT {POST_KEY}, strftime(published, {ISO}) AS published FROM posts
QUALIFY row_number() OVER (PARTITION BY upper(link) ORDER BY {NEWEST_SQL}) = 1""",
)
def _(spark, sf):
    kept = pst.dedup_by_link(v.posts(spark, sf).drop("title", "summary"), [])
    return kept.select("item_pos", "link", "source_name", format_iso(C("published")).alias("published"))


@query(
    "w2_new_posts_topk",
    f"WITH {CHOICE_SQL} SELECT digest_id, item_pos, rank FROM new_posts",
)
def _(spark, sf):
    return choice(spark, sf).new_posts.select(
        "digest_id", "item_pos", C("rank").cast("bigint").alias("rank")
    )


@query(
    "w3_display_posts",
    f"WITH {CHOICE_SQL} SELECT digest_id, item_pos, rank, is_new_post FROM shown",
)
def _(spark, sf):
    return choice(spark, sf).shown.select(
        "digest_id", "item_pos", C("rank").cast("bigint").alias("rank"), "is_new_post"
    )


@query(
    "w4_translation_slice",
    f"WITH {CHOICE_SQL} SELECT digest_id, item_pos, rank - 1 AS index FROM shown WHERE rank <= 10",
)
def _(spark, sf):
    part = pst.translation_slice(choice(spark, sf).shown)
    return part.select("digest_id", "item_pos", C("index").cast("bigint").alias("index"))


RECENT_SQL = f"""WITH {PROCESSED_SQL}
SELECT link, source_name, strftime(coalesce(processed_date, ts), {ISO}) AS processed_time,
  {quoted(DEFAULT_EMOJI)} AS emoji FROM """


def _recent(found):
    return found.select("link", "source_name", format_iso(C("processed_time")).alias("processed_time"), "emoji")


@query(
    "w5_recent_posts",
    RECENT_SQL
    + f"""processed WHERE ts >= {AS_OF_SQL} - INTERVAL 1 DAY
ORDER BY coalesce(processed_date, ts) DESC, pk, rk, ts LIMIT 15""",
)
def _(spark, sf):
    return _recent(stt.recent_posts(v.processed(spark, sf), v.as_of()))


@query(
    "w6_processed_time",
    f"""WITH {PROCESSED_SQL} SELECT link, source_name,
  strftime(coalesce(processed_date, ts), {ISO}) AS processed_time FROM processed""",
)
def _(spark, sf):
    time = stt.processed_time(C("processed_date"), C("ts"))
    return v.processed(spark, sf).select("link", "source_name", format_iso(time).alias("processed_time"))


@query(
    "w7_recent_fallback_scan",
    RECENT_SQL
    + f"""(SELECT * FROM processed ORDER BY pk, rk, ts LIMIT 500)
WHERE coalesce(processed_date, ts) >= {AS_OF_SQL} - INTERVAL 1 DAY
ORDER BY coalesce(processed_date, ts) DESC, pk, rk, ts LIMIT 15""",
)
def _(spark, sf):
    return _recent(stt.recent_fallback_scan(v.processed(spark, sf), v.as_of()))


@query(
    "w7_recent_posts_or_scan",
    RECENT_SQL
    + f"""processed WHERE ts >= {AS_OF_SQL} - INTERVAL 1 DAY
ORDER BY coalesce(processed_date, ts) DESC, pk, rk, ts LIMIT 15""",
)
def _(spark, sf):
    return _recent(stt.recent_posts_or_scan(v.processed(spark, sf), v.as_of()))


@query(
    "w7_scan_when_none_is_recent",
    f"""WITH {PROCESSED_SQL}, late AS (SELECT * REPLACE (ts - INTERVAL 9 DAY AS ts) FROM processed)
SELECT link, source_name, strftime(coalesce(processed_date, ts), {ISO}) AS processed_time,
  {quoted(DEFAULT_EMOJI)} AS emoji FROM (SELECT * FROM late ORDER BY pk, rk, ts LIMIT 500)
WHERE coalesce(processed_date, ts) >= {AS_OF_SQL} - INTERVAL 1 DAY
ORDER BY coalesce(processed_date, ts) DESC, pk, rk, ts LIMIT 15""",
)
def _(spark, sf):
    """Store times nine days old: nothing is recent by them, so the scan answers."""
    late = v.processed(spark, sf).withColumn("ts", F.expr("ts - INTERVAL 9 DAYS"))
    return _recent(stt.recent_posts_or_scan(late, v.as_of()))


def _stored_sql(shift: str, tail: str) -> str:
    return f"""WITH {PROCESSED_SQL}, moved AS (SELECT * REPLACE (ts - {shift} AS ts) FROM processed),
turns AS (SELECT *, 0 AS turn FROM moved UNION ALL SELECT *, 1 FROM moved WHERE ts >= {AS_OF_SQL} - INTERVAL 12 HOUR),
state AS (
  SELECT * FROM turns QUALIFY row_number() OVER (
    PARTITION BY pk, rk ORDER BY turn DESC, processed_date DESC NULLS LAST, link, title, publish_date, ts) = 1)
SELECT link, source_name, strftime(coalesce(processed_date, ts), {ISO}) AS processed_time,
  {quoted(DEFAULT_EMOJI)} AS emoji FROM {tail}
ORDER BY coalesce(processed_date, ts) DESC, pk, rk, ts LIMIT 15"""


@query("w5_recent_posts_stored", _stored_sql("INTERVAL 0 DAY", f"state WHERE ts >= {AS_OF_SQL} - INTERVAL 1 DAY"))
def _(spark, sf):
    """From the stored table: only the days asked for are read."""
    return _recent(_stored(spark, sf).recent_posts(v.as_of()))


@query(
    "w7_scan_when_none_is_recent_stored",
    _stored_sql(
        "INTERVAL 9 DAY",
        f"(SELECT * FROM state ORDER BY pk, rk, ts LIMIT 500) WHERE coalesce(processed_date, ts) >= {AS_OF_SQL} - INTERVAL 1 DAY",
    ),
)
def _(spark, sf):
    """From the stored table: the keys are sorted without their rows."""
    return _recent(_stored(spark, sf, "INTERVAL 9 DAYS").recent_posts_or_scan(v.as_of()))


@query(
    "w8_status_by_name",
    f"""WITH {STATUS_SQL} SELECT digest_id, source_name, items_new, ok, row_number() OVER (
  PARTITION BY digest_id ORDER BY upper(source_name), feed_pos, feed_id) AS position FROM statuses""",
)
def _(spark, sf):
    ordered = sts.status_by_name(run_statuses(spark, sf))
    return _positioned(ordered.select("digest_id", "source_name", "items_new", "ok", "position"))


@query(
    "w8_status_as_listed",
    f"""WITH {STATUS_SQL} SELECT digest_id, source_name, items, ok, row_number() OVER (
  PARTITION BY digest_id ORDER BY feed_pos, feed_id) AS position FROM statuses""",
)
def _(spark, sf):
    ordered = sts.status_as_listed(run_statuses(spark, sf))
    return _positioned(ordered.select("digest_id", "source_name", "items", "ok", "position"))


def _exceptions(spark, sf):
    return v.events(spark, sf).filter("event_type = 'error'").select(
        "ts", C("event_type").alias("type"), C("props").alias("outer_message")
    )


@query(
    "w9_recent_exceptions",
    f"""SELECT strftime(ts, {ISO}) AS ts, event_type AS type, props AS outer_message,
  row_number() OVER (ORDER BY events.ts DESC, event_type, props) AS position FROM events
WHERE event_type = 'error' AND events.ts > {WINDOW_SQL} ORDER BY events.ts DESC, event_type, props LIMIT 10""",
)
def _(spark, sf):
    found = sts.recent_exceptions(_exceptions(spark, sf), v.as_of())
    return _positioned(found.withColumn("ts", format_iso(C("ts"))))


@query(
    "w9_recent_errors",
    f"""WITH {TRACES_SQL} SELECT strftime(ts, {ISO}) AS ts, message, severity::BIGINT AS severity
FROM traces WHERE traces.ts > {WINDOW_SQL} AND traces.severity >= 3""",
)
def _(spark, sf):
    found = sts.recent_errors(v.traces(spark, sf), v.as_of())
    return found.select(format_iso(C("ts")).alias("ts"), "message", C("severity").cast("bigint").alias("severity"))


# --- sets --------------------------------------------------------------------------------


@query(
    "u1_union_feeds",
    f"""WITH {DOCUMENTS_SQL} SELECT feed_group, count(*) AS n, count(DISTINCT link) AS links
FROM docs GROUP BY 1""",
)
def _(spark, sf):
    docs = v.documents(spark, sf).select("feed_group", "link")
    parts = [docs.filter(C("feed_group") == g) for g in ("security", "azureCloud")]
    both = rws.union_feeds(parts)
    per_link = both.groupBy("feed_group", "link").agg(F.count(F.lit(1)).alias("c"))
    return per_link.groupBy("feed_group").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("links")
    )


@query(
    "u2_placeholder_rows",
    f"""WITH {POSTS_SQL}, {FEEDS_SQL}
SELECT feed_id, source_name, {quoted(PLACEHOLDER_TITLES[0])} AS title,
  {quoted(PLACEHOLDER_SUMMARY)} AS summary, '' AS link FROM feeds
WHERE feed_id NOT IN (SELECT feed_id FROM posts WHERE lang = 'fr'
  AND published >= {AS_OF_SQL} - INTERVAL 6 HOUR)""",
)
def _(spark, sf):
    items = flt.new_window_filter(v.posts(spark, sf), v.as_of(), 6).filter("lang = 'fr'")
    rows = rws.placeholder_rows(v.feeds(spark, sf), items, v.as_of())
    return rows.select("feed_id", "source_name", "title", "summary", "link")


@query(
    "u3_fallback_if_empty",
    f"""WITH {POSTS_SQL}, a AS (SELECT * FROM posts WHERE lang = 'fr' AND published >= {WINDOW_SQL})
SELECT feed_id, item_pos FROM a UNION ALL
SELECT feed_id, item_pos FROM posts WHERE feed_id NOT IN (SELECT feed_id FROM a)""",
)
def _(spark, sf):
    posts = v.posts(spark, sf).select("feed_id", "item_pos", "lang", "published")
    first = flt.new_window_filter(posts, v.as_of(), 24).filter("lang = 'fr'")
    return rws.fallback_if_empty(first, posts, "feed_id").select("feed_id", "item_pos")


@query(
    "u4_distinct_nocase",
    """WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
SELECT doc_id, pos, line FROM l
QUALIFY row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY pos) = 1""",
)
def _(spark, sf):
    docs = v.table(spark, sf, "documents")
    kept = rws.distinct_lines(docs, "doc_id", F.split("text", "\n"))
    return kept.select("doc_id", C("pos").cast("bigint").alias("pos"), "line")


# --- subject -----------------------------------------------------------------------------


@query(
    "t33_subject_line",
    f"""SELECT event_id, CASE WHEN user_id % 4 > 0
  THEN replace({quoted(SUBJECT_NEW)}, '%d', (user_id % 4)::VARCHAR) ELSE {quoted(SUBJECT_NONE)} END
  AS subject FROM events""",
)
def _(spark, sf):
    return v.events(spark, sf).select("event_id", subject_line(C("user_id") % 4).alias("subject"))
