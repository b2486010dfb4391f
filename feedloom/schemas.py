"""Schemas of the tables the operators read and write."""

from __future__ import annotations

FEEDS = (
    "feed_id STRING, feed_group STRING, feed_pos INT, source_name STRING, url STRING, "
    "emoji STRING, category STRING, active BOOLEAN"
)
DIGEST_RUNS = (
    "digest_id STRING, feed_group STRING, as_of TIMESTAMP, days_since INT, max_items INT, "
    "new_window_hours INT, schedule_text STRING"
)
FEED_PAYLOADS = (
    "feed_id STRING, fetched_at TIMESTAMP, http_status INT, body STRING, error STRING, "
    "elapsed_ms BIGINT"
)
FEED_ITEMS = (
    "feed_id STRING, item_pos INT, title STRING, links ARRAY<STRING>, summary STRING, "
    "published_raw STRING, updated_raw STRING, categories ARRAY<STRING>"
)
PAGES = "url STRING, status INT, content_type STRING, html STRING"
PROCESSED = (
    "pk STRING, rk STRING, title STRING, link STRING, source_name STRING, summary STRING, "
    "publish_date STRING, english_summary STRING, korean_summary STRING, "
    "processed_date TIMESTAMP, ts TIMESTAMP"
)
MODEL_RESPONSES = "digest_id STRING, status INT, body STRING"

_REGISTRY_ENTRY = (
    "ARRAY<STRUCT<sourceName: STRING, url: STRING, emoji: STRING, category: STRING, "
    "active: BOOLEAN, notes: STRING>>"
)
FEED_CONFIG = f"securityFeeds {_REGISTRY_ENTRY}, azureCloudFeeds {_REGISTRY_ENTRY}"

_CHANNEL = (
    "channel: STRUCT<item: ARRAY<STRUCT<title: STRING, link: ARRAY<STRING>, "
    "description: STRING, pubDate: STRING, `a10:updated`: STRING, `atom:updated`: STRING, "
    "category: ARRAY<STRING>>>>"
)
# Both formats at once: the root of a feed has a channel or entries.
_ATOM_TEXT = "STRUCT<_VALUE: STRING, _type: STRING>"
_ENTRY = (
    f"entry: ARRAY<STRUCT<title: {_ATOM_TEXT}, "
    f"link: ARRAY<STRUCT<_href: STRING, _rel: STRING>>, summary: {_ATOM_TEXT}, "
    "published: STRING, updated: STRING, category: ARRAY<STRUCT<_term: STRING>>>>"
)
RSS = f"STRUCT<{_CHANNEL}>"
ATOM = f"STRUCT<{_ENTRY}>"
FEED_XML = f"STRUCT<{_CHANNEL}, {_ENTRY}, title: {_ATOM_TEXT}, id: STRING>"
