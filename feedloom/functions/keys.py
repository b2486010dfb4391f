"""State keys of a post."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.constants import DEFAULT_EMOJI, EMOJI_MAIL, EMOJI_RECENT, UNKNOWN_SOURCE
from feedloom.functions.text import text_or_empty

EMOJI_MAPS = {"recent": EMOJI_RECENT, "mail": EMOJI_MAIL}


def partition_key(source: Column) -> Column:
    return F.replace(F.coalesce(source, F.lit(UNKNOWN_SOURCE)), F.lit(" "), F.lit(""))


def row_key(link: Column) -> Column:
    """SHA-256 of the link as URL-safe base64, padding kept."""
    return F.translate(F.base64(F.unhex(F.sha2(text_or_empty(link), 256))), "/+", "_-")


def source_emoji(source: Column, map_name: str) -> Column:
    """Emoji of a source; the maps hold fewer than twenty entries, so a literal serves."""
    table = F.create_map(*[F.lit(x) for pair in EMOJI_MAPS[map_name].items() for x in pair])
    return F.coalesce(F.try_element_at(table, text_or_empty(source)), F.lit(DEFAULT_EMOJI))
