"""Feed payloads, items and registry on hand-made rows."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from feedloom import schemas
from feedloom.functions.dates import parse_pubdate, published_or_updated
from feedloom.operators import status as sts
from feedloom.sources import feeds as fds
from feedloom.sources import tables as tbs

C = F.col("c")

RSS = """<?xml version="1.0"?><!DOCTYPE rss><rss version="2.0" xmlns:dc="d" xmlns:content="x"><channel>
<title>t</title><!-- note --><item><title><![CDATA[A & B]]></title><link>https://x/1</link>
<description><![CDATA[<p>Hello <b>you</b> &amp; me</p>]]></description>
<dc:creator>me</dc:creator><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate>
<category>s</category><category>z</category></item>
<item><link>https://x/2</link><pubDate>Mon, 01 Jan 1990 00:00:00 +0000</pubDate>
<a10:updated xmlns:a10="a">2024-01-01T01:02:03Z</a10:updated></item>
<item><title>No date</title><description>d</description></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry><title>One</title>
<link href="https://y/1" rel="alternate"/><link href="https://y/2"/><summary>S &lt;i&gt;x&lt;/i&gt;</summary>
<updated>2024-01-02T03:04:05.678Z</updated><category term="k"/></entry></feed>"""


@pytest.fixture(scope="module")
def payloads(spark):
    rows = [
        ("rss", None, 200, RSS, None, 5),
        ("atom", None, 200, ATOM, None, 5),
        ("cut", None, 200, RSS[:300], None, 5),
        ("html", None, 200, "<!DOCTYPE html><html></html>", None, 5),
        ("empty", None, 200, "", None, 5),
        ("down", None, 503, None, "timeout", 12000),
        ("denied", None, 403, RSS, None, 9),
    ]
    return spark.createDataFrame(rows, schemas.FEED_PAYLOADS)


def test_items(payloads):
    rows = fds.clean_items(fds.parse_feeds(payloads)).orderBy("feed_id", "item_pos").collect()
    found = [(r.feed_id, r.item_pos, r.title, r.link, r.summary, r.categories) for r in rows]
    assert found == [
        ("atom", 0, "One", "https://y/1", "S x", ["k"]),
        ("rss", 0, "A & B", "https://x/1", "Hello you & me", ["s", "z"]),
        ("rss", 1, "No title", "https://x/2", "", []),
        ("rss", 2, "No date", "", "d", []),
    ]
    when = [r.published for r in rows]
    assert when[0] == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert when[1] == dt.datetime(2024, 1, 2, 10)
    assert when[2] == dt.datetime(2024, 1, 1, 1, 2, 3)
    assert when[3] is None


def test_prefixed_tags_are_no_fields_of_an_item(spark):
    body = """<rss xmlns:media="m" xmlns:atom="a"><channel><item><title>Real</title><media:title>Media</media:title>
<link> </link><atom:link href="https://self"/><link>https://x/1</link><media:description>MD</media:description>
<description>D</description><media:link>https://m</media:link></item></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:media="m"><entry><media:title>Media</media:title>
<title>Real</title><media:summary>MS</media:summary><link href="https://y"/></entry></feed>"""
    rows = [("r", None, 200, body, None, 1), ("s", None, 200, atom, None, 1)]
    items = fds.clean_items(fds.parse_feeds(spark.createDataFrame(rows, schemas.FEED_PAYLOADS)))
    found = [(r.title, r.link, r.summary) for r in items.orderBy("feed_id").collect()]
    assert found == [("Real", "https://x/1", "D"), ("Real", "https://y", "")]
    assert [r.reason for r in fds.undated_items(items).collect()] == ["no readable date"] * 2


def test_payload_report(payloads):
    found = {r.feed_id: (r.kind, r.entries, r.reason) for r in sts.payload_report(payloads).collect()}
    assert found["rss"] == ("xml", 3, None)
    assert found["atom"] == ("other", 1, "Not XML format")
    assert found["html"][2] == "HTML instead of XML"
    assert found["empty"][2] == "Not XML format"
    assert found["down"][2] == "timeout"
    assert found["denied"][2] == "HTTP 403"


def test_outcomes(spark, payloads):
    more = spark.createDataFrame(
        [
            ("bare", None, 200, "<feed><title>t</title></feed>", None, 1),
            ("void", None, 200, "<rss><channel></channel></rss>", None, 1),
            ("text", None, 200, "hello", None, 1),
        ],
        schemas.FEED_PAYLOADS,
    )
    found = {r.feed_id: r.error for r in fds.payload_outcomes(payloads.unionByName(more)).collect()}
    assert found == {
        "rss": None,
        "atom": None,
        "bare": None,
        "void": None,
        "cut": "Not XML format",
        "html": "HTML instead of XML",
        "empty": "Not XML format",
        "text": "Not XML format",
        "down": "timeout",
        "denied": "HTTP 403",
    }


def test_payload_summary(payloads):
    found = {(r.valid, r.reason): r.payloads for r in sts.payload_summary(payloads).collect()}
    assert found == {
        (True, "OK"): 2,
        (False, "Not XML format"): 2,
        (False, "HTML instead of XML"): 1,
        (False, "timeout"): 1,
        (False, "HTTP 403"): 1,
    }


def test_dates(evaluate):
    rows = [
        "Tue, 02 Jan 2024 10:00:00 GMT",
        "2 Jan 2024 10:00 +0900",
        "Tue, 2 Jan 24 10:00:00 EST",
        "2024-01-02T10:00:00+09:00",
        "2024-01-02T10:00:00.9Z",
        "soon",
        "",
        None,
    ]
    found = evaluate(parse_pubdate(C), rows)
    at = dt.datetime(2024, 1, 2, 10)
    assert found[:5] == [at, at - dt.timedelta(hours=9), at + dt.timedelta(hours=5), at - dt.timedelta(hours=9), at]
    assert found[5:] == [None, None, None]


def test_published_fallback(evaluate):
    late = F.lit("2024-05-05").cast("timestamp")
    rows = ["1999-12-31", "2000-01-01", None]
    found = evaluate(published_or_updated(C.cast("timestamp"), late), rows)
    assert found == [dt.datetime(2024, 5, 5), dt.datetime(2000, 1, 1), dt.datetime(2024, 5, 5)]


def test_registry(spark, tmp_path):
    entry = {"sourceName": "N", "url": "u", "emoji": "🛡️", "category": "c", "active": True, "notes": ""}
    config = {"version": "2", "securityFeeds": [entry, {**entry, "active": False}], "azureCloudFeeds": [entry]}
    path = tmp_path / "feeds.json"
    path.write_text(json.dumps(config, indent=1), encoding="utf8")
    rows = fds.feed_registry(fds.read_feed_config(spark, str(path))).collect()
    assert sorted((r.feed_group, r.feed_pos) for r in rows) == [("azureCloud", 0), ("security", 0)]


def test_names(evaluate):
    rows = [None, " ", "A"]
    assert evaluate(fds.source_default(C), rows) == ["Unknown", "Unknown", "A"]
    assert evaluate(fds.status_source_default(C), rows) == ["Unknown", " ", "A"]


def test_pages(spark):
    rows = [
        ("a", 200, "TEXT/HTML", "x2"),
        ("a", 200, "text/html", "x1"),
        ("b", 404, "text/html", "y"),
        ("c", 200, "application/pdf", "z"),
        ("d", 200, None, "w"),
    ]
    pages = spark.createDataFrame(rows, schemas.PAGES)
    first = min(("x1", "x2"), key=lambda x: hashlib.md5(x.encode()).hexdigest())
    assert [tuple(r) for r in tbs.load_pages(pages, text=F.col("html")).collect()] == [("a", first)]
    assert tbs.load_pages(pages, need_html_type=False).count() == 3
    links = spark.createDataFrame([("D",), ("B",), ("x",)], "link STRING")
    found = tbs.load_pages(pages, False, links, text=F.concat("html", F.lit("!"))).collect()
    assert [tuple(r) for r in found] == [("d", "w!")]


def test_ticks(spark):
    spans = spark.createDataFrame(
        [("g", [7, 19], "Asia/Seoul", dt.date(2024, 1, 1), dt.date(2024, 1, 2))],
        "feed_group STRING, hours ARRAY<INT>, tz STRING, first_day DATE, last_day DATE",
    )
    found = sorted(r.tick for r in tbs.schedule_ticks(spans).collect())
    first = dt.datetime(2023, 12, 31, 22)
    assert found == [first + dt.timedelta(hours=12 * i) for i in range(4)]
