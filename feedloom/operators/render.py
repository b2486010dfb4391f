"""Digest pages: cards per post, status tables, one page per digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.constants import (
    DEFAULT_EMOJI,
    KO_CARD_FILLERS,
    LABELS,
    SUBJECT_NEW,
    SUBJECT_NONE,
    UNKNOWN_SOURCE,
)
from feedloom.functions.dates import display_day_ko, display_minute
from feedloom.functions.html import contains_hangul, emoji_entities, html_encode, scrub_phrase
from feedloom.functions.keys import source_emoji
from feedloom.functions.lines import clean_point, normalize_bullets
from feedloom.functions.text import is_blank, no_strings, text_or_empty
from feedloom.operators.filters import is_placeholder


def subject_line(count: Column) -> Column:
    return F.when(count > 0, F.format_string(SUBJECT_NEW, count)).otherwise(F.lit(SUBJECT_NONE))


def _div(cls: str, *inner: Column | str) -> Column:
    parts = [F.lit(p) if isinstance(p, str) else p for p in inner]
    return F.concat(F.lit(f'<div class="{cls}">'), *parts, F.lit("</div>"))


def _unless(blank: Column, part: Column) -> Column:
    return F.when(blank, F.lit("")).otherwise(part)


def _each(lines: Column, open_: str, close: str) -> Column:
    return F.array_join(
        F.transform(lines, lambda b: F.concat(F.lit(open_), html_encode(b), F.lit(close))), ""
    )


def _link(link: Column, cls: str) -> Column:
    return F.concat(
        F.lit(f'<a class="{cls}" href="'), html_encode(link), F.lit(f'">{LABELS["read"]}</a>')
    )


def post_card_html(tz: str = "Asia/Seoul") -> Column:
    """One escaped card from the columns of a display post."""
    emoji = F.when(is_blank(F.col("emoji")), F.lit(DEFAULT_EMOJI)).otherwise(F.col("emoji"))
    source = html_encode(F.coalesce("source_name", F.lit(UNKNOWN_SOURCE)))
    title = html_encode(F.coalesce("title", F.lit(LABELS["untitled"])))
    tag = F.concat(F.lit('<span class="tag">'), emoji, F.lit(" "), source, F.lit("</span>"))
    korean = F.coalesce("korean_summary", no_strings())
    own = F.when(F.exists(korean, contains_hangul), korean).otherwise(no_strings())
    bullets = _each(normalize_bullets(own, KO_CARD_FILLERS), "<li>", "</li>")
    paragraph = F.col("first_paragraph")
    return _div(
        "post",
        _div("post-title", tag, title),
        _unless(
            F.col("published").isNull(), _div("date", "📅 ", display_minute(F.col("published"), tz))
        ),
        _unless(
            is_blank(paragraph),
            F.concat(
                _div("label", LABELS["paragraph"]),
                _div("paragraph", html_encode(text_or_empty(paragraph))),
            ),
        ),
        _div("label", LABELS["insights"]),
        F.concat(F.lit('<ul class="bullets">'), bullets, F.lit("</ul>")),
        _unless(is_blank(F.col("link")), _link(F.col("link"), "link")),
    )


def _cells(*values: Column) -> Column:
    return F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *values), F.lit("</td></tr>"))


def status_rows(statuses: DataFrame) -> DataFrame:
    """Table rows of the feed states of each digest, in both orders.

    One page lists every feed of its digest, so these rows belong to one value by definition.
    """
    n = F.col("items_new")
    short = F.when(n > 0, F.format_string(LABELS["status_count"], n)).otherwise(
        F.lit(LABELS["status_zero"])
    )
    state = F.when(F.col("ok"), F.lit("OK")).otherwise(F.lit("FAIL"))
    name = html_encode(F.col("source_name"))
    detail = _cells(
        name,
        state,
        n.cast("string"),
        F.col("items").cast("string"),
        F.concat(F.coalesce("elapsed_ms", F.lit(0)).cast("string"), F.lit(" ms")),
        html_encode(text_or_empty(F.col("error"))),
    )
    rows = statuses.select(
        "digest_id",
        F.struct(
            F.upper("source_name").alias("k"), "feed_pos", "feed_id", _cells(name, short, state).alias("r")
        ).alias("s"),
        F.struct("feed_pos", "feed_id", detail.alias("r")).alias("d"),
    )
    return rows.groupBy("digest_id").agg(
        F.array_join(F.array_sort(F.collect_list("s"))["r"], "").alias("summary_rows"),
        F.array_join(F.array_sort(F.collect_list("d"))["r"], "").alias("detail_rows"),
    )


def digest_html(
    runs: DataFrame, posts: DataFrame, statuses: DataFrame, footer: str = ""
) -> DataFrame:
    """One page per run from its display posts, thirty at most, and its feed states.

    `posts` needs digest_id, rank, card and is_recent.
    """
    cards = posts.groupBy("digest_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("rank", "card")))["card"], "").alias("cards"),
        F.count(F.lit(1)).alias("shown"),
        F.count_if("is_recent").alias("recent"),
    )
    joined = (
        runs.join(cards, "digest_id", "left")
        .join(status_rows(statuses), "digest_id", "left")
        .na.fill(0, ["shown", "recent"])
        .na.fill("", ["cards", "summary_rows", "detail_rows"])
    )
    hours, days, recent = F.col("new_window_hours"), F.col("days_since"), F.col("recent")

    def label(name: str, *values: Column) -> Column:
        return F.format_string(LABELS[name], *values)

    meta = F.when(recent > 0, label("count_new", recent, hours)).otherwise(
        label("count_none", hours)
    )
    head = _div(
        "header",
        f"<h1>{LABELS['heading']}</h1>",
        _div("meta", meta),
        _div("schedule", html_encode(F.col("schedule_text"))),
    )

    def table(columns: list[Column], rows: str) -> Column:
        titles = F.concat(
            F.lit("<tr><th>"), F.concat_ws("</th><th>", *columns), F.lit("</th></tr>")
        )
        return F.concat(F.lit("<table>"), titles, F.col(rows), F.lit("</table>"))

    summary = table(
        [F.lit("Source"), label("status_columns", hours), F.lit(LABELS["status_state"])],
        "summary_rows",
    )
    detail = table(
        [
            F.lit("Source"),
            F.lit("Status"),
            label("status_columns", hours),
            label("detail_days", days),
            F.lit("Elapsed"),
            F.lit("Error"),
        ],
        "detail_rows",
    )
    nothing = _div(
        "post", _div("post-title", LABELS["no_posts"]), _div("hint", LABELS["no_posts_hint"])
    )
    body = _div(
        "content",
        _div("status", _div("label", label("status_heading", hours)), summary),
        _unless(recent > 0, _div("notice", label("no_new", hours))),
        _unless(F.col("shown") > 0, nothing),
        F.col("cards"),
        _div("detail", _div("label", F.lit(LABELS["detail_heading"])), detail),
    )
    page = F.concat(
        F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"></head><body>'),
        _div("container", head, body, _div("footer", html_encode(F.lit(footer)))),
        F.lit("</body></html>"),
    )
    # The time of the run says where its digest is kept.
    time = [c for c in ("as_of",) if c in runs.columns]
    return joined.select(
        "digest_id", "feed_group", *time, subject_line(recent).alias("subject"), page.alias("html")
    )


def assemble_digest(posts: DataFrame, statuses: DataFrame, runs: DataFrame) -> DataFrame:
    """Per digest: subject, ordered posts and feed states as arrays."""
    listed = posts.groupBy("digest_id").agg(
        F.array_sort(
            F.collect_list(F.struct("rank", "title", "link", "source_name", "published"))
        ).alias("posts"),
        F.count_if("is_recent").alias("recent_posts"),
    )
    feeds = statuses.groupBy("digest_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "feed_pos", "feed_id", "source_name", "ok", "items", "items_new", "elapsed_ms", "error"
                )
            )
        ).alias("feeds")
    )
    joined = runs.select("digest_id", "feed_group").join(listed, "digest_id", "left")
    return joined.join(feeds, "digest_id", "left").withColumn(
        "subject", subject_line(F.coalesce("recent_posts", F.lit(0)))
    )


def mail_html(requests: DataFrame, cards: DataFrame, footer: str = "") -> DataFrame:
    """Subject and page per mail request, the unwanted phrase removed.

    `requests`: digest_id, has_new, schedule_text. `cards`: digest_id, rank, card and
    is_placeholder, for the posts a mail shows.
    """
    listed = cards.groupBy("digest_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("rank", "card")))["card"], "").alias("cards"),
        F.count(F.lit(1)).alias("shown"),
        F.count_if(~F.col("is_placeholder")).alias("actual_new"),
    )
    joined = (
        requests.join(listed, "digest_id", "left")
        .na.fill(0, ["shown", "actual_new"])
        .na.fill("", ["cards"])
    )
    new, shown = F.col("actual_new"), F.col("shown")
    count = F.when(new > 0, F.format_string(LABELS["mail_new"], new)).otherwise(
        F.lit(LABELS["legacy_none"])
    )
    error = _div(
        "post",
        _div("post-title", LABELS["mail_error"]),
        _div("post-summary", LABELS["mail_error_hint"]),
    )
    note = (
        F.when(shown == 0, error)
        .when(~F.col("has_new") & (new == 0), _div("no-new-notice", LABELS["mail_no_new"]))
        .otherwise(F.lit(""))
    )
    page = F.concat(
        F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"></head><body>'),
        _div(
            "container",
            _div("header", f"<h1>{LABELS['heading']}</h1>", _div("count", count)),
            _div("content", note, F.col("cards")),
            _div("footer", html_encode(F.lit(footer)), html_encode(F.col("schedule_text"))),
        ),
        F.lit("</body></html>"),
    )
    return joined.select(
        "digest_id", subject_line(new).alias("subject"), scrub_phrase(page).alias("html")
    )


def legacy_card() -> Column:
    """A card of the older layout.

    Columns: title, summary, source_name, emoji, published, link, summary_text, excerpt, en and
    ko, the last three being line arrays.
    """
    source = F.col("source_name")
    no_source = text_or_empty(source) == ""
    emoji = F.when(text_or_empty(F.col("emoji")) != "", F.col("emoji")).otherwise(
        emoji_entities(source_emoji(source, "mail"))
    )
    none = _div(
        "placeholder",
        emoji,
        " ",
        F.when(no_source, F.lit(LABELS["legacy_unknown"])).otherwise(html_encode(source)),
        f": {LABELS['legacy_none']}",
    )

    def points(cls: str, label: str, lines: str) -> Column:
        clean = F.transform(lines, clean_point)
        return _div(cls, _div("label", LABELS[label]), _each(clean, "<div>• ", "</div>"))

    three = F.slice(F.concat(F.col("excerpt"), F.array_repeat(F.lit(""), 3)), 1, 3)
    tag = F.concat(F.lit('<span class="tag">'), html_encode(source), F.lit("</span>"))
    excerpt = F.when(
        F.size("excerpt") > 0, _div("excerpt", _each(three, "<div>", "</div>"))
    ).otherwise(_div("post-summary", html_encode(F.col("summary_text"))))
    day = F.concat(F.lit("📅 "), display_day_ko(F.col("published")))
    card = _div(
        "post",
        _div("post-title", _unless(no_source, tag), html_encode(text_or_empty(F.col("title")))),
        _div("post-meta", _unless(F.col("published").isNull(), day)),
        excerpt,
        points("insights-en", "legacy_en", "en"),
        points("insights-ko", "legacy_ko", "ko"),
        _link(text_or_empty(F.col("link")), "post-link"),
    )
    return F.when(is_placeholder(F.col("title"), F.col("summary")), none).otherwise(card)
