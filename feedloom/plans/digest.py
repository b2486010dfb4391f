"""Scheduled digests: many runs over many feeds in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.constants import MAX_MAX_ITEMS, NO_PAYLOAD
from feedloom.functions.html import first_paragraph_chain, first_paragraph_page
from feedloom.functions.lines import extract_bullets, normalize_bullets
from feedloom.functions.text import no_strings
from feedloom.operators.counts import feed_counts, links_per_run
from feedloom.operators.filters import clamp_params, is_new, valid_feeds
from feedloom.operators.insights import attach_insights, diagnostics, parse_insights
from feedloom.operators.posts import (
    check_duplicate,
    dedup_by_link,
    display_posts,
    item_key,
    runs_to_items,
    translation_slice,
)
from feedloom.operators.render import digest_html, post_card_html
from feedloom.operators.rows import enrich_pages
from feedloom.operators.state import to_state_rows
from feedloom.operators.status import digest_counts, status_from_counts
from feedloom.session import settle
from feedloom.sources.feeds import (
    clean_items,
    items_to_feeds,
    latest_outcomes,
    parse_feeds,
    undated_items,
)
from feedloom.sources.tables import load_pages


@dataclass
class Choice:
    """What a set of runs shows: narrow tables, without article text."""

    runs: DataFrame
    links: DataFrame
    shown: DataFrame

    def settled(self) -> Choice:
        """The same choice, made once and written: a few rows per run."""
        return Choice(self.runs, settle(self.links, "links"), settle(self.shown, "shown"))

    @property
    def new_posts(self) -> DataFrame:
        return self.shown.filter("is_new_post").drop("is_new_post")


def choose_posts(runs: DataFrame, items: DataFrame, state_keys: DataFrame) -> Choice:
    """Window, dedup, state check and top posts per run.

    A run sees the items of its `days_since` days that also lie in its window. Only keys, links
    and times are shuffled. The newest copy of a link lies in the window whenever any copy
    does, so the window filter runs first.
    """
    clean = clamp_params(runs)
    narrow = items.select("feed_group", "feed_pos", *item_key(items), "link", "source_name", "published")
    hours = F.least(F.col("days_since") * 24, F.col("new_window_hours")).alias("hours")
    asked = clean.select("digest_id", "feed_group", "as_of", "max_items", "new_window_hours", hours)
    recent = dedup_by_link(runs_to_items(asked, narrow, "hours"), ["digest_id"])
    flagged = check_duplicate(recent, state_keys).drop("hours")
    shown = display_posts(flagged, F.col("max_items"), MAX_MAX_ITEMS)
    return Choice(clean, links_per_run(clean, narrow), shown)


def with_text(shown: DataFrame, items: DataFrame) -> DataFrame:
    """Display posts with title, summary, emoji and bullets.

    A run shows at most thirty posts, so the chosen keys are the small side; Spark decides by
    their size whether they are sent to the items.
    """
    key = item_key(items)
    text = items.select(*key, "title", "summary", "emoji")
    bullets = normalize_bullets(extract_bullets(F.col("summary")))
    return text.join(shown, key).withColumn("english_summary", bullets)


def with_paragraph(posts: DataFrame, pages: DataFrame) -> DataFrame:
    """Display posts with the first paragraph of their page, if it was fetched well.

    Only pages of display posts are searched, and their html is cut before any shuffle.
    """
    found = load_pages(
        pages, need_html_type=False, links=posts, page_text=first_paragraph_page(F.col("html"))
    )
    chain = first_paragraph_chain(F.col("page_text"), F.col("summary"))
    return enrich_pages(posts, found).withColumn("first_paragraph", chain).drop("page_text")


def with_insights(posts: DataFrame, insights: DataFrame) -> DataFrame:
    """Insights for the translated slice; later posts get an empty list."""
    index = translation_slice(posts).select("digest_id", "rank", "index")
    found = attach_insights(index, insights).select("digest_id", "rank", "korean_summary")
    joined = posts.join(found, ["digest_id", "rank"], "left")
    return joined.withColumn("korean_summary", F.coalesce("korean_summary", no_strings()))


def render(
    runs: DataFrame, posts: DataFrame, statuses: DataFrame, tz: str = "Asia/Seoul", footer: str = ""
) -> DataFrame:
    """Subject and page per run."""
    cards = posts.select(
        "digest_id",
        "rank",
        is_new(F.col("as_of"), F.col("new_window_hours")).alias("is_recent"),
        post_card_html(tz).alias("card"),
    )
    return digest_html(runs, cards, statuses, footer)


def new_state_rows(posts: DataFrame) -> DataFrame:
    """Rows to append to the state table: the new posts, handled at their run's `as_of`."""
    return to_state_rows(posts.filter("is_new_post"), F.col("as_of"))


def ingest(payloads: DataFrame, feeds: DataFrame) -> DataFrame:
    """Clean items of all usable payloads, with their feed. Write them once, then read them."""
    return items_to_feeds(clean_items(parse_feeds(payloads)), valid_feeds(feeds))


def run_statuses(
    runs: DataFrame, feeds: DataFrame, payloads: DataFrame, items: DataFrame
) -> DataFrame:
    """Feed states of each run: items of its `days_since` days, before any dedup.

    A month of items belongs to dozens of runs, so they are counted by running totals.
    """
    answers = latest_outcomes(payloads).withColumn("_given", F.lit(True))
    missing = F.when(F.col("_given").isNull(), F.lit(NO_PAYLOAD)).otherwise(F.col("error"))
    listed = (
        valid_feeds(feeds)
        .join(answers, "feed_id", "left")
        .withColumn("error", missing)
        .join(
            runs.select("digest_id", "feed_group", "as_of", "days_since", "new_window_hours"),
            "feed_group",
        )
    )
    return status_from_counts(listed, counts_per_feed(listed, items))


def counts_per_feed(listed: DataFrame, items: DataFrame) -> DataFrame:
    """Items and new items per run and feed; `listed` has a row for each run and feed."""
    days = F.col("days_since") * 24
    asked = listed.select(
        "digest_id", "feed_group", "feed_id", "as_of", days.alias("old_hours"),
        F.least(days, F.col("new_window_hours")).alias("new_hours"),
    )
    return feed_counts(asked, items, {"items": "old_hours", "items_new": "new_hours"})


@dataclass
class Digests:
    """Everything a set of runs yields."""

    pages: DataFrame
    posts: DataFrame
    statuses: DataFrame
    stats: DataFrame
    state_rows: DataFrame
    rejects: DataFrame


def build_digests(
    runs: DataFrame,
    feeds: DataFrame,
    payloads: DataFrame,
    items: DataFrame,
    state_keys: DataFrame,
    pages: DataFrame,
    responses: DataFrame,
    tz: str = "Asia/Seoul",
    footer: str = "",
) -> Digests:
    """Pages, posts, feed states, counts, new state rows and rejected items of all runs.

    `items` are those of `ingest`; `pages` has url, status and html.
    """
    chosen = choose_posts(runs, items, state_keys).settled()
    posts = settle(with_text(chosen.shown, items), "display")
    return finish_digests(chosen, posts, feeds, payloads, items, pages, responses, tz, footer)


def finish_digests(
    chosen: Choice,
    posts: DataFrame,
    feeds: DataFrame,
    payloads: DataFrame,
    items: DataFrame,
    pages: DataFrame,
    responses: DataFrame,
    tz: str = "Asia/Seoul",
    footer: str = "",
) -> Digests:
    """The digests of a choice that is made: `posts` are its display posts with text.

    Callers that ask the model about the posts in between settle both first. Feed states go into pages and answer
    alike, so they are settled here.
    """
    informed = with_insights(posts, parse_insights(responses))
    ready = with_paragraph(informed, pages)
    statuses = settle(run_statuses(chosen.runs, feeds, payloads, items), "statuses")
    counts = digest_counts(chosen.links, posts, chosen.runs)
    said = diagnostics(chosen.runs, responses, informed)
    stats = chosen.runs.select("digest_id", "days_since", "new_window_hours").join(
        counts, "digest_id"
    )
    return Digests(
        pages=render(chosen.runs, ready, statuses, tz, footer),
        posts=ready,
        statuses=statuses,
        stats=stats.join(said, "digest_id"),
        state_rows=new_state_rows(informed),
        rejects=undated_items(items),
    )
