"""Row filters and request parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.constants import (
    DEFAULT_DAYS_SINCE,
    DEFAULT_MAX_ITEMS,
    DEFAULT_SCHEDULE_TEXT,
    DEFAULT_SUMMARY_POINTS,
    DEFAULT_WINDOW_HOURS,
    EMPTY_EN,
    EMPTY_KO,
    MAX_MAX_ITEMS,
    MAX_WINDOW_HOURS,
    PLACEHOLDER_SUMMARY,
    PLACEHOLDER_TITLES,
)
from feedloom.functions.dates import ago
from feedloom.functions.text import is_blank, text_or_empty, trim_u


def recency_filter(items: DataFrame, as_of: Column, days_since: Column | int) -> DataFrame:
    """Items not older than `days_since` days; undated ones go."""
    return items.filter(F.col("published") >= ago(as_of, days=days_since))


def is_new(as_of: Column, hours: Column | int) -> Column:
    return F.date_trunc("second", F.col("published")) >= ago(as_of, hours=hours)


def new_window_filter(posts: DataFrame, as_of: Column, hours: Column | int) -> DataFrame:
    return posts.filter(is_new(as_of, hours))


def nonblank_link(posts: DataFrame) -> DataFrame:
    return posts.filter(~is_blank(F.col("link")))


def _clamp(name: str, default: int, top: int | None = None) -> Column:
    value = F.col(name) if top is None else F.least(F.col(name), F.lit(top))
    return F.when(F.col(name) > 0, value).otherwise(F.lit(default))


def clamp_params(runs: DataFrame) -> DataFrame:
    """Digest requests with defaults and caps applied."""
    text = F.col("schedule_text")
    return runs.withColumns(
        {
            "days_since": _clamp("days_since", DEFAULT_DAYS_SINCE),
            "max_items": _clamp("max_items", DEFAULT_MAX_ITEMS, MAX_MAX_ITEMS),
            "new_window_hours": _clamp("new_window_hours", DEFAULT_WINDOW_HOURS, MAX_WINDOW_HOURS),
            "schedule_text": F.when(is_blank(text), F.lit(DEFAULT_SCHEDULE_TEXT)).otherwise(
                trim_u(text)
            ),
        }
    )


def valid_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.filter(~is_blank(F.col("url")))


def rejected_runs(runs: DataFrame, feeds: DataFrame) -> DataFrame:
    """Requests whose feed group lists no feed at all."""
    return runs.join(feeds.select("feed_group").distinct(), "feed_group", "left_anti")


def is_placeholder(title: Column, summary: Column) -> Column:
    return F.coalesce(title.isin(PLACEHOLDER_TITLES), F.lit(False)) | F.coalesce(
        summary == PLACEHOLDER_SUMMARY, F.lit(False)
    )


def has_required_fields(link: Column, source: Column) -> Column:
    """Both fields are there; blanks count as given, only empty text does not."""
    return (text_or_empty(link) != "") & (text_or_empty(source) != "")


def required_fields(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows fit for the state table, and the rejected rest."""
    good = has_required_fields(F.col("link"), F.col("source_name"))
    return rows.filter(good), rows.filter(~good)


def summary_points(raw: Column) -> Column:
    text = trim_u(raw)
    value = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))
    return F.when(value.between(1, 10), value).otherwise(F.lit(DEFAULT_SUMMARY_POINTS))


def empty_content_summary(title: Column, content: Column) -> Column:
    """The fixed pair of summaries for a post without title or content, else null."""
    missing = (text_or_empty(title) == "") | (text_or_empty(content) == "")
    return F.when(
        missing,
        F.struct(
            F.array(F.lit(EMPTY_EN)).alias("english_summary"),
            F.array(F.lit(EMPTY_KO)).alias("korean_summary"),
        ),
    )
