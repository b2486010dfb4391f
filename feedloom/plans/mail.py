"""The older mail: excerpt lines and insight lines per post."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.html import (
    drop_boilerplate_lines,
    main_content_html,
    readable_text,
    strip_tags_full,
    summary_cut,
)
from feedloom.functions.json_cols import field_any_case, field_text, string_array_lenient
from feedloom.functions.lines import (
    MAX_EXCERPT,
    excerpt_lines,
    excerpt_three,
    insights_both,
)
from feedloom.functions.text import is_blank, settled_columns
from feedloom.operators.filters import is_placeholder
from feedloom.operators.render import legacy_card, mail_html
from feedloom.operators.rows import enrich_pages, fallback_if_empty
from feedloom.sources.tables import load_pages


def page_text(pages: DataFrame) -> DataFrame:
    """Pages with `article_text`; one step per column keeps the generated code small."""
    rows = settled_columns(pages, _main=main_content_html(F.col("html")))
    rows = settled_columns(rows, _text=readable_text(F.col("_main")))
    return rows.withColumn("article_text", drop_boilerplate_lines(F.col("_text"))).drop("_main", "_text")


def article_text(pages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Clean text per url, case ignored; with `links`, of linked pages only."""
    if links is not None:
        wanted = links.select(F.lower("link").alias("_wanted")).distinct()
        pages = pages.join(wanted, F.lower("url") == F.col("_wanted"), "left_semi")
    return load_pages(page_text(pages), need_html_type=False, article_text=F.col("article_text"))


def insight_source(posts: DataFrame, articles: DataFrame) -> DataFrame:
    """Posts with `article_text` and `fallback`: article, else summary, else the excerpt.

    The article is found by link, ignoring case.
    """
    joined = enrich_pages(posts, articles)
    full = strip_tags_full(F.col("summary"))
    return settled_columns(joined, summary_text=summary_cut(F.col("summary")), _full=full)


@cache
def _excerpt() -> Column:
    return excerpt_three(F.col("_page_lines"), F.col("summary_text"))


@cache
def _insight_lines() -> Column:
    names = ["english_summary", "korean_summary", "_lines", "fallback", "link"]
    return insights_both(*[F.col(n) for n in names])


def mail_lines(posts: DataFrame, articles: DataFrame) -> DataFrame:
    """Posts with excerpt lines and English and Korean insight lines.

    The two large expressions name columns only, so they are built once and reused. Each step is settled before
    the next: their lambdas would otherwise compute the steps before them anew for every line.
    """
    fallback = (
        F.when(~is_blank(F.col("article_text")), F.col("article_text"))
        .when(~is_blank(F.col("_full")), F.col("_full"))
        .otherwise(F.array_join("excerpt", " "))
    )
    rows = settled_columns(insight_source(posts, articles), _page_lines=excerpt_lines(F.col("article_text"), 3))
    rows = settled_columns(rows, excerpt=_excerpt())
    rows = settled_columns(rows, fallback=fallback)
    rows = settled_columns(rows, _lines=excerpt_lines(F.col("fallback"), MAX_EXCERPT))
    rows = settled_columns(rows, _both=_insight_lines())
    named = rows.withColumns({"en": F.col("_both")[0], "ko": F.col("_both")[1]})
    return named.drop("_page_lines", "_lines", "_full", "_both")


def mail_cards(posts: DataFrame, articles: DataFrame) -> DataFrame:
    return mail_lines(posts, articles).withColumn("card", legacy_card())


def mail_pages(
    requests: DataFrame, new: DataFrame, recent: DataFrame, pages: DataFrame, footer: str = ""
) -> DataFrame:
    """One mail per request from its new posts, or from its recent ones when it has none.

    `requests`: digest_id and schedule_text. Posts need digest_id and rank. `pages`: url, status
    and html; those that no post links to are not searched. `mail_cards` gives the cards as rows,
    for more posts than one page should hold.
    """
    shown = fallback_if_empty(new, recent, "digest_id")
    cards = mail_cards(shown, article_text(pages, shown)).select(
        "digest_id",
        "rank",
        "card",
        is_placeholder(F.col("title"), F.col("summary")).alias("is_placeholder"),
    )
    filled = new.select("digest_id", F.lit(True).alias("has_new")).distinct()
    asked = requests.join(filled, "digest_id", "left").na.fill(False, ["has_new"])
    return mail_html(asked, cards, footer)


def posts_from_requests(requests: DataFrame, member: str = "posts") -> DataFrame:
    """Posts of JSON requests; names may be camelCase or PascalCase, lists may be JSON text."""
    parsed = requests.select("request_id", F.try_parse_json("body").alias("v"))
    listed = F.try_variant_get(field_any_case(F.col("v"), member), "$", "array<variant>")
    items = parsed.select("request_id", F.posexplode(listed).alias("item_pos", "p"))
    texts = {
        "title": "title",
        "link": "link",
        "publish_date": "publishDate",
        "summary": "summary",
        "source_name": "sourceName",
        "emoji": "emoji",
    }
    return items.select(
        "request_id",
        "item_pos",
        *[field_text(F.col("p"), key).alias(name) for name, key in texts.items()],
        string_array_lenient(field_any_case(F.col("p"), "englishSummary")).alias("english_summary"),
        string_array_lenient(field_any_case(F.col("p"), "koreanSummary")).alias("korean_summary"),
    )
