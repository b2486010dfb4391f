"""Cards, pages and mail cards on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from feedloom.functions.constants import KO_CARD_FILLERS, LABELS, SUBJECT_NONE
from feedloom.functions.dates import display_day_ko, display_minute, format_iso
from feedloom.operators import render as rnd
from feedloom.plans import mail
from feedloom.sources import tables as tbs
from feedloom.workload.views import as_of

C = F.col("c")
NOW = dt.datetime(2024, 1, 3, 16, 30, 5)


def test_subject(evaluate):
    found = evaluate(rnd.subject_line(C), [3, 0], "INT")
    assert found[0].endswith("새 게시글 3개")
    assert found[1] == SUBJECT_NONE


def test_times(evaluate):
    assert evaluate(display_minute(C), [NOW, None], "TIMESTAMP") == ["2024-01-04 01:30", None]
    assert evaluate(display_day_ko(C, "Asia/Seoul"), [NOW], "TIMESTAMP") == ["2024년 01월 04일"]
    assert evaluate(format_iso(C), [NOW], "TIMESTAMP") == ["2024-01-03T16:30:05Z"]


def cards(spark):
    rows = [
        ("d", 1, "T <1>", "https://a?x=1&y=2", "S & T", "🔐", NOW, "First.", ["가", "나"], True),
        ("d", 2, None, " ", None, " ", None, "  ", ["english"], True),
    ]
    posts = spark.createDataFrame(
        rows,
        "digest_id STRING, rank INT, title STRING, link STRING, source_name STRING, emoji STRING, "
        "published TIMESTAMP, first_paragraph STRING, korean_summary ARRAY<STRING>, is_recent BOOLEAN",
    )
    return posts.withColumn("card", rnd.post_card_html())


def test_card(spark):
    full, bare = [r.card for r in cards(spark).orderBy("rank").collect()]
    assert "🔐 S &amp; T</span>T &lt;1&gt;" in full
    assert 'href="https://a?x=1&amp;y=2"' in full
    assert "2024-01-04 01:30" in full and "First." in full and full.count("<li>") == 3
    assert "<li>가</li>" in full
    assert "📰 Unknown</span>(no title)" in bare
    assert "href" not in bare and 'class="date"' not in bare and LABELS["paragraph"] not in bare
    assert all(f"<li>{line}</li>" in bare for line in KO_CARD_FILLERS)


def digest(spark, posts):
    runs = spark.createDataFrame(
        [("d", "g", 30, 24, "at <7>"), ("e", "g", 30, 24, "at 8")],
        "digest_id STRING, feed_group STRING, days_since INT, new_window_hours INT, schedule_text STRING",
    )
    states = spark.createDataFrame(
        [("d", "f1", 2, "b", True, 3, 1, 5, None), ("d", "f2", 1, "C", False, 0, 0, 7, "x<y")],
        "digest_id STRING, feed_id STRING, feed_pos INT, source_name STRING, ok BOOLEAN, items BIGINT, "
        "items_new BIGINT, elapsed_ms BIGINT, error STRING",
    )
    return runs, states, rnd.digest_html(runs, posts, states, footer="made by us")


def test_page(spark):
    _, _, pages = digest(spark, cards(spark))
    found = {r.digest_id: r for r in pages.collect()}
    page = found["d"].html
    assert found["d"].subject.endswith("새 게시글 2개")
    assert page.index("T &lt;1&gt;") < page.index("(no title)")
    assert page.index("<td>b</td><td>1개") < page.index("<td>C</td><td>없음")
    assert page.rindex("<td>C</td>") < page.rindex("<td>b</td>")
    assert "x&lt;y" in page and "at &lt;7&gt;" in page and "made by us" in page
    empty = found["e"].html
    assert found["e"].subject == SUBJECT_NONE
    assert LABELS["no_posts"] in empty and "신규 게시글이 없어" in empty


def test_assembled(spark):
    posts = cards(spark)
    runs, states, _ = digest(spark, posts)
    found = {r.digest_id: r for r in rnd.assemble_digest(posts, states, runs).collect()}
    assert [p["rank"] for p in found["d"].posts] == [1, 2]
    assert [f["feed_id"] for f in found["d"].feeds] == ["f2", "f1"]
    assert found["e"].posts is None and found["e"].subject == SUBJECT_NONE


def pages_of(spark, *rows):
    return spark.createDataFrame(rows, "digest_id STRING, feed_group STRING, as_of TIMESTAMP, subject STRING, html STRING")


def test_written_digests_stay(spark, tmp_path):
    path, day = str(tmp_path / "out"), dt.timedelta(days=1)

    def kept(where="true"):
        return sorted((r.digest_id, r.html) for r in tbs.read_digests(spark, path).filter(where).collect())

    first = pages_of(spark, ("s1", "security", NOW, "S", "1"), ("t1", "tech", NOW, "S", "2"))
    tbs.write_digests(first, path)
    tbs.write_digests(pages_of(spark, ("t2", "tech", NOW + day, "S", "3")), path)
    tbs.write_digests(pages_of(spark, ("t3", "tech", NOW + day / 4, "S", "4")), path)
    assert kept() == [("s1", "1"), ("t1", "2"), ("t2", "3"), ("t3", "4")]
    tbs.write_digests(first, path)
    tbs.write_digests(first.filter("false"), path)
    assert kept() == [("s1", "1"), ("t1", "2"), ("t2", "3"), ("t3", "4")]
    tbs.write_digests(pages_of(spark, ("t1", "tech", NOW, "S", "new")), path)
    assert kept() == [("s1", "1"), ("t1", "new"), ("t2", "3"), ("t3", "4")]
    assert kept("feed_group = 'tech' AND run_day = DATE'2024-01-03'") == [("t1", "new"), ("t3", "4")]


def test_mail_cards(spark):
    posts = spark.createDataFrame(
        [
            ("Post", "https://X", "<p>Short summary here.</p>", "Azure Blog", None, NOW, ["• Point one"], ["- 하나"]),
            ("No new posts in last 7 days", "", "x", "", None, NOW, None, None),
            (None, None, None, None, "⚡", None, None, None),
        ],
        "title STRING, link STRING, summary STRING, source_name STRING, emoji STRING, "
        "published TIMESTAMP, english_summary ARRAY<STRING>, korean_summary ARRAY<STRING>",
    )
    pages = spark.createDataFrame(
        [("https://x", 200, "<article><p>Page one. Page two. Page three. Page four.</p></article>")],
        "url STRING, status INT, html STRING",
    )
    out = mail.mail_cards(posts, mail.article_text(pages)).collect()
    by_title = {r.title: r for r in out}
    full = by_title["Post"]
    assert full.excerpt == ["Page one.", "Page two.", "Page three."]
    assert full.en == ["Point one", "Page one.", "Page two."]
    assert full.ko == ["하나", "Page one.", "Page two."]
    assert "2024년 01월 03일" in full.card
    note = by_title["No new posts in last 7 days"].card
    assert "Unknown Source" in note and "&#55357;&#56560;" in note
    blank = by_title[None]
    assert blank.excerpt == [] and len(blank.en) == 3 and len(blank.ko) == 3


def test_as_of_is_fixed(spark):
    assert spark.range(1).select(as_of()).collect()[0][0] == dt.datetime(2024, 1, 3, 12)
