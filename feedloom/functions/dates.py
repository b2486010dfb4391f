"""Publish times: reading, formatting, cutoffs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import trim_u

# Zone names of RFC 822 dates.
ZONES = {
    "GMT": "+0000",
    "UTC": "+0000",
    "UT": "+0000",
    "Z": "+0000",
    "EST": "-0500",
    "EDT": "-0400",
    "CST": "-0600",
    "CDT": "-0500",
    "MST": "-0700",
    "MDT": "-0600",
    "PST": "-0800",
    "PDT": "-0700",
}
# Layouts of RFC 822 dates once the weekday is gone.
RFC_LAYOUTS = [
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm Z",
    "d MMM yy HH:mm:ss Z",
    "d MMM yy HH:mm Z",
]


def parse_pubdate(raw: Column) -> Column:
    """RFC 822 or ISO text to a whole-second timestamp, null when neither."""
    text = trim_u(raw)
    bare = F.regexp_replace(text, r"^[A-Za-z]+,\s*", "")
    zone = F.regexp_extract(bare, r"\s([A-Za-z]+)$", 1)
    table = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    offset = F.try_element_at(table, F.upper(zone))
    bare = F.when(
        zone != "", F.concat(F.regexp_replace(bare, r"[A-Za-z]+$", ""), offset)
    ).otherwise(bare)
    rfc = [
        F.try_to_timestamp(F.regexp_replace(bare, r"\s+", " "), F.lit(layout))
        for layout in RFC_LAYOUTS
    ]
    iso = F.when(text.rlike(r"^\d{4}-\d{2}"), text.try_cast("timestamp"))
    return F.date_trunc("second", F.coalesce(iso, *rfc))


def published_or_updated(published: Column, updated: Column) -> Column:
    """The update time stands in for a missing or implausible publish time."""
    return F.when(published.isNull() | (F.year(published) < 2000), updated).otherwise(published)


def format_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def display_minute(ts: Column, tz: str = "Asia/Seoul") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM-dd HH:mm")


def display_day_ko(ts: Column, tz: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), "yyyy'년' MM'월' dd'일'")


def ago(as_of: Column, *, days: Column | int = 0, hours: Column | int = 0) -> Column:
    return as_of - F.make_dt_interval(
        days=F.lit(days) if isinstance(days, int) else days,
        hours=F.lit(hours) if isinstance(hours, int) else hours,
    )


def bin_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts)
