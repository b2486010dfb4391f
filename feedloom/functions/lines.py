"""Bullets, excerpt lines and insight lines of a post.

All loops run over at most eight lines, so the folds stay small per row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.constants import (
    BANNED_LIMITS,
    BANNED_TOPIC,
    BLANK_SUMMARY_BULLETS,
    BULLETS,
    EN_FILLERS,
    KO_UNAVAILABLE,
    LEGACY_PREFIX,
    POINT_CHARS,
    SAFE_LINES,
    UNWANTED_PAIR,
    UNWANTED_PHRASE,
    WS,
    WS_CHARS,
)
from feedloom.functions.html import contains_hangul
from feedloom.functions.text import (
    clip,
    collapse_ws,
    cut_u16,
    fits_u16,
    is_blank,
    len_u16,
    let,
    lits,
    no_strings,
    same_text,
    text_or_empty,
    trim_u,
)

MAX_EXCERPT = 8
ELLIPSIS = "…"


# --- bullets -----------------------------------------------------------------------------


def sanitize_bullet(c: Column) -> Column:
    bare = trim_u(text_or_empty(c))
    rest = F.substring(bare, len(LEGACY_PREFIX) + 1, F.char_length(bare))
    return F.when(bare.startswith(LEGACY_PREFIX), trim_u(rest)).otherwise(bare)


def normalize_bullets(bullets: Column, fillers: list[str] = EN_FILLERS, count: int = 3) -> Column:
    """Exactly `count` bullets; the last filler repeats when they run out."""
    clean = F.filter(
        F.transform(F.coalesce(bullets, no_strings()), sanitize_bullet), lambda x: x != ""
    )
    padded = fillers[:count] + [fillers[-1]] * (count - len(fillers))
    return F.slice(F.concat(clean, lits(padded)), 1, count)


def extract_bullets(summary: Column) -> Column:
    """The first three sentences of at least 20 characters."""

    def cut(text: Column) -> Column:
        parts = F.filter(
            F.transform(F.split(text, rf"(?<=[.!?])[{WS}]+"), trim_u), lambda s: ~fits_u16(s, 19)
        )
        three = F.transform(F.slice(parts, 1, 3), lambda s: clip(s, 160, "..."))
        some = let(
            three, lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(clip(text, 140, "...")))
        )
        return F.when(text == "", lits(BLANK_SUMMARY_BULLETS)).otherwise(normalize_bullets(some))

    return let(trim_u(text_or_empty(summary)), cut)


def strip_bullet_marker(c: Column) -> Column:
    bare = trim_u(text_or_empty(c))
    bare = F.regexp_replace(bare, rf"^[{WS}]*[-*{BULLETS}][{WS}]+", "")
    return trim_u(F.regexp_replace(bare, rf"^[{WS}]*\p{{Nd}}+[{WS}]*[.|)][{WS}]+", ""))


def normalize_punctuation(c: Column) -> Column:
    """Curly quotes, dashes and ellipsis to ASCII."""
    plain = F.translate(text_or_empty(c), "‘’“”–—", "''\"\"--")
    return collapse_ws(F.replace(plain, F.lit(ELLIPSIS), F.lit("...")))


def clean_point(c: Column) -> Column:
    """A line as it is rendered: no bullet characters, one line."""
    bare = F.translate(text_or_empty(c), POINT_CHARS, "")
    return F.replace(collapse_ws(bare), F.lit(ELLIPSIS), F.lit("..."))


# --- line tests --------------------------------------------------------------------------


def _plain(line: Column) -> Column:
    bare = F.regexp_replace(text_or_empty(line), rf"^[{WS}{BULLETS}\-*]+", "")
    return F.lower(F.replace(bare, F.lit(ELLIPSIS), F.lit("...")))


def _holds(line: Column, phrase: str) -> Column:
    return F.contains(line, F.lit(phrase))


def _unwanted(plain: Column) -> Column:
    both = _holds(plain, UNWANTED_PAIR[0]) & _holds(plain, UNWANTED_PAIR[1])
    return _holds(plain, UNWANTED_PHRASE) | both


def _banned(plain: Column) -> Column:
    limits = [_holds(plain, phrase) for phrase in BANNED_LIMITS]
    return _holds(plain, BANNED_TOPIC) & reduce(or_, limits)


def unwanted_sentence(line: Column) -> Column:
    return let(_plain(line), _unwanted)


def banned_variant(line: Column) -> Column:
    return let(_plain(line), _banned)


def _allowed(line: Column) -> Column:
    """Neither unwanted nor banned; every unwanted sentence is a banned variant too."""
    return ~banned_variant(line)


def drop_lines_in_summary(lines: Column, summary: Column) -> Column:
    """Lines that the summary does not hold already."""

    def drop(whole: Column) -> Column:
        kept = F.filter(
            F.transform(lines, trim_u), lambda x: (x != "") & ~F.contains(whole, F.lower(x))
        )
        return F.when(whole == "", lines).otherwise(kept)

    return let(F.lower(trim_u(text_or_empty(summary))), drop)


# --- cutting text into lines -------------------------------------------------------------


def _before_last_space(c: Column, beyond: int | Column, blanks: str) -> Column:
    """`c` up to its last blank when that lies past `beyond`, else all of `c`."""
    return let(
        F.regexp_extract(c, rf"(?s)^(.*)[{blanks}]", 1),
        lambda head: F.when(len_u16(head) > beyond, head).otherwise(c),
    )


def _clip_sentence(s: Column) -> Column:
    cut = let(cut_u16(s, 300), lambda c: _before_last_space(c, 150, r" \t\n\r"))
    short = F.concat(F.rtrim(cut, F.lit(WS_CHARS)), F.lit(ELLIPSIS))
    return F.when(fits_u16(s, 300), s).otherwise(short)


def _chunk_step(acc: Column, count: int) -> Column:
    """Take 300 units off the rest of the text and keep them as a line."""

    def cut(head: Column) -> Column:
        rest = trim_u(F.substring(acc.rest, F.char_length(head) + 1, F.char_length(acc.rest)))

        def finish(chunk: Column) -> Column:
            whole = let(
                _before_last_space(chunk, 120, r" \t\n\r"),
                lambda b: F.when(F.char_length(b) < F.char_length(chunk) - 1, trim_u(b)).otherwise(
                    chunk
                ),
            )
            return let(
                rest,
                lambda r: F.struct(
                    F.concat(
                        acc.lines,
                        F.array(F.when(r != "", F.concat(whole, F.lit(ELLIPSIS))).otherwise(whole)),
                    ).alias("lines"),
                    r.alias("rest"),
                ),
            )

        return let(trim_u(head), finish)

    more = (F.size(acc.lines) < count) & (acc.rest != "")
    return F.when(more, let(cut_u16(acc.rest, 300), cut)).otherwise(acc)


def excerpt_lines(text: Column, count: int) -> Column:
    """Up to `count` sentences; a short text is cut again from its start by length."""

    def cut(bare: Column) -> Column:
        sentences = F.filter(
            F.transform(F.split(bare, rf"(?<=[.!?\x{{3002}}\x{{FF01}}\x{{FF1F}}])[{WS}]+"), trim_u),
            lambda s: s != "",
        )

        def fill(lines: Column) -> Column:
            folded = F.aggregate(
                F.sequence(F.lit(1), F.lit(count)),
                F.struct(lines.alias("lines"), bare.alias("rest")),
                lambda acc, _: _chunk_step(acc, count),
            )
            return F.when(F.size(lines) >= count, lines).otherwise(folded["lines"])

        first = F.transform(F.slice(sentences, 1, count), _clip_sentence)
        return F.when(bare == "", no_strings()).otherwise(let(first, fill))

    return let(trim_u(text_or_empty(text)), cut)


def chunk_lines(text: Column, count: int | Column, limit: int, most: int | None = None) -> Column:
    """Up to `count` pieces of at most `limit` units, cut at a space; `most` bounds a column."""
    most = count if isinstance(count, int) else most

    def step(acc: Column, i: Column) -> Column:
        def cut(head: Column) -> Column:
            third = F.greatest(F.lit(80), F.floor(len_u16(head) / 3).cast("int"))

            def finish(piece: Column) -> Column:
                more = F.char_length(piece) < F.char_length(acc.rest)
                taken = F.least(
                    F.char_length(head),
                    F.greatest(F.lit(1), F.char_length(piece) + more.cast("int")),
                )
                line = F.when(more, F.concat(piece, F.lit(ELLIPSIS))).otherwise(piece)
                rest = F.substring(acc.rest, taken + 1, F.char_length(acc.rest))
                return F.struct(
                    F.concat(acc.lines, F.array(line)).alias("lines"), rest.alias("rest")
                )

            return let(trim_u(_before_last_space(head, third, " ")), finish)

        return F.when(
            (i <= count) & (acc.rest != ""), let(cut_u16(acc.rest, limit), cut)
        ).otherwise(acc)

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(most)),
        F.struct(no_strings().alias("lines"), collapse_ws(text_or_empty(text)).alias("rest")),
        step,
        lambda acc: acc.lines,
    )


# --- joining lines -----------------------------------------------------------------------

# A candidate is a line with its lower case and whether it is allowed, each worked out once. Lists of lines grow by folds
# over candidates; what a fold has kept are candidates again.

_CANDIDATES = "array<struct<text:string,low:string,ok:boolean>>"


def _candidates(lines: Column) -> Column:
    return F.transform(
        lines, lambda x: F.struct(x.alias("text"), F.lower(x).alias("low"), _allowed(x).alias("ok"))
    )


def _nothing() -> Column:
    return F.array().cast(_CANDIDATES)


def _same(a: Column, b: Column) -> Column:
    return a["low"] == b["low"]


def _overlap(a: Column, b: Column) -> Column:
    return F.contains(a["low"], b["low"]) | F.contains(b["low"], a["low"])


def _usable(x: Column) -> Column:
    return x["ok"] & (x["text"] != "")


def _take(
    kept: Column, more: Column, clash: Callable[[Column, Column], Column], count: int = 3
) -> Column:
    """Append candidates of `more` that clash with none before, up to `count`."""
    return F.aggregate(
        more,
        kept,
        lambda acc, x: F.when(
            (F.size(acc) < count) & ~F.exists(acc, lambda r: clash(r, x)),
            F.concat(acc, F.array(x)),
        ).otherwise(acc),
    )


def _texts(candidates: Column) -> Column:
    return F.transform(candidates, lambda x: x["text"])


def _add_lines(
    lines: Column, more: Column, clash: Callable[[Column, Column], Column], count: int = 3
) -> Column:
    """Append lines of `more` that clash with none before, up to `count`."""
    return F.aggregate(
        more,
        lines,
        lambda acc, x: F.when(
            (F.size(acc) < count) & ~F.exists(acc, lambda r: clash(r, x)),
            F.concat(acc, F.array(x)),
        ).otherwise(acc),
    )


def distinct_nocase(lines: Column, count: int = 3) -> Column:
    """The first `count` lines that differ, ignoring case."""
    return _add_lines(no_strings(), lines, same_text, count)


def _nonblank(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~is_blank(x))


def excerpt_three(page_lines: Column, summary: Column) -> Column:
    """Three lines from the page, topped up from the summary."""
    lines = F.filter(drop_lines_in_summary(page_lines, summary), lambda x: ~unwanted_sentence(x))
    from_summary = F.filter(excerpt_lines(summary, 6), lambda x: ~unwanted_sentence(x))

    def top_up(have: Column) -> Column:
        pieces = F.filter(
            chunk_lines(summary, 3 - F.size(have), 300, most=3), lambda x: ~unwanted_sentence(x)
        )
        return F.when(F.size(have) >= 3, have).otherwise(F.concat(have, pieces))

    filled = let(
        lines,
        lambda have: F.when(F.size(have) >= 3, have).otherwise(
            let(_add_lines(have, from_summary, same_text), top_up)
        ),
    )
    return F.slice(filled, 1, 3)


def _three(own: Column, excerpt: Column) -> Column:
    """Own candidates first, then those of an excerpt."""
    lines = _take(_take(_nothing(), own, _same), F.slice(excerpt, 1, 6), _overlap)
    return _take(lines, F.slice(excerpt, 1, 3), _same)


def _own_points(points: Column) -> Column:
    return _candidates(_nonblank(F.transform(F.coalesce(points, no_strings()), strip_bullet_marker)))


def _trimmed(lines: Column) -> Column:
    return _candidates(F.transform(lines, trim_u))


def three_insights(points: Column, excerpt: Column) -> Column:
    """Model points first, then lines of the fallback `excerpt` (eight excerpt lines)."""
    return let(_trimmed(excerpt), lambda e: _texts(_three(_own_points(points), e)))


def _exactly_three(own: Column, excerpt: Column, fallback: Column) -> Column:
    """Three allowed lines from candidates of both kinds, short pieces of the fallback, then fixed ones."""

    def top_up(have: Column, more: Column, clash: Callable[[Column, Column], Column]) -> Column:
        # `more` is worked out only where lines are missing.
        return F.when(F.size(have) >= 3, have).otherwise(_take(have, F.filter(more, _usable), clash))

    first = _take(_nothing(), F.filter(own, lambda x: x["ok"] & ~is_blank(x["text"])), _same)
    filled = let(
        first,
        lambda a: let(
            top_up(a, excerpt, _overlap),
            lambda b: let(
                top_up(b, _trimmed(chunk_lines(fallback, 6, 160)), _overlap),
                lambda c: top_up(c, _candidates(lits(SAFE_LINES)), _same),
            ),
        ),
    )
    return F.slice(F.concat(_texts(filled), F.array_repeat(F.lit(""), 3)), 1, 3)


def exactly_three_insights(lines: Column, excerpt: Column, fallback: Column) -> Column:
    """Three allowed lines: given ones, excerpt lines, short pieces, then fixed ones."""
    return let(_trimmed(excerpt), lambda e: _exactly_three(_candidates(lines), e, fallback))


def sanitized_points(points: Column) -> Column:
    clean = F.transform(_nonblank(F.coalesce(points, no_strings())), normalize_punctuation)
    return F.filter(clean, lambda x: ~unwanted_sentence(x))


def _insights(points: Column, excerpt: Column, fallback: Column) -> Column:
    """`excerpt` holds candidates, which both folds share."""
    return _exactly_three(_three(_own_points(points), excerpt), excerpt, fallback)


def insights_en(points: Column, excerpt: Column, fallback: Column) -> Column:
    return let(_trimmed(excerpt), lambda e: _insights(sanitized_points(points), e, fallback))


def _spare_ko(link: Column) -> Column:
    source = F.when(is_blank(link), F.lit(KO_UNAVAILABLE[2] + ".")).otherwise(
        F.concat(F.lit(KO_UNAVAILABLE[2] + ": "), link)
    )
    return F.array(F.lit(KO_UNAVAILABLE[0]), F.lit(KO_UNAVAILABLE[1]), source)


def _has_hangul(points: Column) -> Column:
    return F.exists(F.coalesce(points, no_strings()), contains_hangul)


def insights_ko(points: Column, excerpt: Column, fallback: Column, link: Column) -> Column:
    """Korean lines; without any Hangul, three fixed lines with the link."""
    lines = let(_trimmed(excerpt), lambda e: _insights(points, e, fallback))
    return F.when(_has_hangul(points), lines).otherwise(_spare_ko(link))


def insights_both(
    english: Column, korean: Column, excerpt: Column, fallback: Column, link: Column
) -> Column:
    """English and Korean lines as an array of two, from one expression for both."""
    given = F.array(sanitized_points(english), F.when(_has_hangul(korean), korean))
    lines = let(
        _trimmed(excerpt),
        lambda e: F.transform(given, lambda points: F.when(points.isNotNull(), _insights(points, e, fallback))),
    )
    return F.array(F.get(lines, F.lit(0)), F.coalesce(F.get(lines, F.lit(1)), _spare_ko(link)))
