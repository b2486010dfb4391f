"""Whole digests and whole mails from payloads to pages and state."""

import datetime as dt
import json

from pyspark.sql import functions as F

from feedloom import schemas
from feedloom.functions.constants import LABELS, SUBJECT_NONE
from feedloom.operators.state import ProcessedPosts
from feedloom.plans import digest as dig
from feedloom.plans import mail

NOW = dt.datetime(2024, 1, 3, 12)


def rss(*items):
    rows = "".join(
        f"<item><title>{t}</title><link>{link}</link><description>{d}</description>"
        f"<pubDate>{when:%a, %d %b %Y %H:%M:%S} GMT</pubDate></item>"
        for t, link, d, when in items
    )
    return f'<?xml version="1.0"?><rss><channel><title>c</title>{rows}</channel></rss>'


def hours(n):
    return NOW - dt.timedelta(hours=n)


def tables(spark):
    runs = spark.createDataFrame(
        [("run", "g", NOW, 30, 12, 24, None), ("quiet", "h", NOW, 30, 12, 24, "at 8")], schemas.DIGEST_RUNS
    )
    feeds = spark.createDataFrame(
        [
            ("f1", "g", 0, "One", "https://1", "🔐", "c", True),
            ("f2", "g", 1, " ", "https://2", None, "c", True),
            ("f3", "g", 2, "Down", "https://3", None, "c", True),
            ("f4", "g", 3, "No url", " ", None, "c", True),
            ("f5", "h", 0, "Quiet", "https://5", None, "c", True),
        ],
        schemas.FEEDS,
    )
    text = "A first sentence of the summary. A second sentence of the summary. Third."
    payloads = spark.createDataFrame(
        [
            ("f1", NOW, 200, rss(("New", "https://x/1", text, hours(1)), ("Old", "https://x/0", text, hours(80)),
                                 ("Seen", "https://x/9", text, hours(2))), None, 11),
            ("f2", NOW, 200, rss(("Copy", "HTTPS://X/1", text, hours(3)), ("Other", "https://x/2", "short", hours(4))), None, 12),
            ("f3", NOW, 503, None, "timeout", 12000),
            ("f4", NOW, 200, rss(("Lost", "https://x/3", text, hours(1))), None, 1),
            ("f5", NOW, 200, "<html></html>", None, 1),
        ],
        schemas.FEED_PAYLOADS,
    )
    pages = spark.createDataFrame(
        [
            ("HTTPS://x/1", 200, "<article><p>Page text</p></article>"),
            ("https://x/2", 404, "<article><p>Not found</p></article>"),
            ("https://x/77", 200, "<article>no</article>"),
        ],
        "url STRING, status INT, html STRING",
    )
    said = {"items": [{"index": 0, "koreanSummary": ["핵심"]}]}
    body = json.dumps({"choices": [{"message": {"content": json.dumps(said)}}]})
    responses = spark.createDataFrame([("run", 200, body)], schemas.MODEL_RESPONSES)
    return runs, feeds, payloads, pages, responses


def test_digest_from_payloads_to_state(spark, tmp_path):
    runs, feeds, payloads, pages, responses = tables(spark)
    state = ProcessedPosts(spark, str(tmp_path / "state"))
    items = dig.ingest(payloads, feeds)
    assert items.count() == 5

    def build():
        return dig.build_digests(runs, feeds, payloads, items, state.keys(), pages, responses)

    seen = items.filter("title = 'Seen'").withColumns(
        {"as_of": F.lit(NOW), "is_new_post": F.lit(True)}
        | {n: F.array().cast("array<string>") for n in ("english_summary", "korean_summary")}
    )
    state.append(dig.new_state_rows(seen), 0)

    first = build()
    posts = first.posts.orderBy("rank").collect()
    assert [(p.title, p.source_name) for p in posts] == [("New", "One"), ("Other", "Unknown")]
    assert posts[0].first_paragraph == "Page text"
    assert posts[1].first_paragraph == "short"
    assert posts[0].korean_summary[0] == "핵심" and posts[1].korean_summary == []
    assert posts[0].english_summary[0] == "A first sentence of the summary."

    states = {s.feed_id: (s.source_name, s.ok, s["items"], s.items_new, s.error) for s in first.statuses.collect()}
    assert states == {
        "f1": ("One", True, 3, 2, None),
        "f2": (" ", True, 2, 2, None),
        "f3": ("Down", False, 0, 0, "timeout"),
        "f5": ("Quiet", False, 0, 0, "HTML instead of XML"),
    }

    stats = {s.digest_id: s for s in first.stats.collect()}
    assert (stats["run"].all_items, stats["run"].new_posts, stats["run"].display_posts) == (4, 2, 2)
    assert stats["run"].succeeded and stats["run"].translated_posts == 1
    assert stats["quiet"].all_items == 0 and not stats["quiet"].configured

    html = {p.digest_id: p for p in first.pages.collect()}
    assert html["run"].subject.endswith("새 게시글 2개")
    assert html["quiet"].subject == SUBJECT_NONE and LABELS["no_posts"] in html["quiet"].html

    state.append(first.state_rows, 1)
    assert state.keys().count() == 3
    second = build()
    assert [p.title for p in second.posts.orderBy("rank").collect()] == ["New", "Seen", "Other"]
    assert second.state_rows.count() == 0
    assert second.pages.filter("digest_id = 'run'").collect()[0].subject.endswith("3개")


def test_mail(spark):
    requests = spark.createDataFrame(
        [("new", "매일"), ("old", "매일"), ("none", "<매일>"), ("void", "매일")], "digest_id STRING, schedule_text STRING"
    )
    fields = (
        "digest_id STRING, rank INT, title STRING, link STRING, summary STRING, source_name STRING, "
        "emoji STRING, published TIMESTAMP, english_summary ARRAY<STRING>, korean_summary ARRAY<STRING>"
    )

    def post(digest, rank, title, summary="Some text here. More text."):
        return (digest, rank, title, "l", summary, "S", None, NOW, None, None)

    new = spark.createDataFrame(
        [post("new", 2, "Second"), post("new", 1, "First"), post("void", 1, "x", "No new posts")], fields
    )
    recent = spark.createDataFrame([post("new", 1, "Not shown"), post("old", 1, "Recent")], fields)
    pages = spark.createDataFrame(
        [("L", 200, "<article>Of the page.</article>"), ("k", 200, "no")], "url STRING, status INT, html STRING"
    )
    found = {r.digest_id: r for r in mail.mail_pages(requests, new, recent, pages).collect()}
    assert "Of the page." in found["new"].html
    assert found["new"].subject.endswith("2개") and "Not shown" not in found["new"].html
    assert found["new"].html.index("First") < found["new"].html.index("Second")
    assert "Recent" in found["old"].html and found["old"].subject.endswith("1개")
    assert found["none"].subject == SUBJECT_NONE
    assert LABELS["mail_error"] in found["none"].html and "&lt;매일&gt;" in found["none"].html
    assert found["void"].subject == SUBJECT_NONE and LABELS["legacy_none"] in found["void"].html
    assert LABELS["mail_error"] not in found["void"].html and LABELS["mail_no_new"] not in found["void"].html
