"""HTML and entity expressions for summaries and article pages."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.constants import (
    BOILERPLATE,
    DEFAULT_EMOJI,
    PAGE_LINES,
    PAGE_SLICE,
    PAGE_TEXT,
    UNWANTED_PHRASE,
    WS,
)
from feedloom.functions.text import (
    clip,
    collapse_ws,
    cut_u16,
    fits_u16,
    is_blank,
    let,
    text_or_empty,
    trim_u,
)

_TOKEN = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);|&|[^&]+"
_WIDE = r"\x{A0}-\x{FF}\x{10000}-\x{10FFFF}"


# Entity text to character: the HTML 4 names and `apos`, as one constant.
_ENTITIES = json.dumps(
    {f"&{name};": chr(code) for name, code in {**name2codepoint, "apos": 39}.items()}
)


def _entity_names() -> Column:
    return F.from_json(F.lit(_ENTITIES), "map<string,string>")


def code_point_char(n: Column) -> Column:
    """The character of a code point, null when there is none."""
    ok = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def _decode_token(tok: Column) -> Column:
    dec = F.regexp_extract(tok, r"^&#0*([0-9]{1,10});$", 1).try_cast("bigint")
    hexa = F.regexp_extract(tok, r"^&#[xX]0*([0-9a-fA-F]{1,8});$", 1)
    number = F.coalesce(dec, F.when(hexa != "", F.conv(hexa, 16, 10).try_cast("bigint")))
    return (
        F.when(~tok.startswith("&") | (tok == "&"), tok)
        .when(tok.startswith("&#"), F.coalesce(code_point_char(number), tok))
        .otherwise(F.coalesce(F.try_element_at(_entity_names(), tok), tok))
    )


def html_decode(c: Column) -> Column:
    """Named and numeric entities, in one pass; the semicolon is needed."""

    def decode(x: Column) -> Column:
        tokens = F.regexp_extract_all(x, F.lit(_TOKEN), F.lit(0))
        decoded = F.array_join(F.transform(tokens, _decode_token), "")
        return F.when(F.contains(x, F.lit("&")), decoded).otherwise(x)

    return let(c, decode)


def html_encode(c: Column) -> Column:
    """Markup characters, Latin-1 letters and astral characters as entities."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for raw, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))

    def number(t: Column) -> Column:
        code = F.concat(F.lit("&#"), F.ascii(t).cast("string"), F.lit(";"))
        return F.when(t.rlike(f"^[{_WIDE}]"), code).otherwise(t)

    def encode(x: Column) -> Column:
        tokens = F.regexp_extract_all(x, F.lit(f"[{_WIDE}]|[^{_WIDE}]+"), F.lit(0))
        numbered = F.array_join(F.transform(tokens, number), "")
        return F.when(x.rlike(f"[{_WIDE}]"), numbered).otherwise(x)

    return let(out, encode)


def strip_tags_lazy(c: Column) -> Column:
    """Tags that end on their own line go; entities are decoded."""
    return trim_u(html_decode(F.regexp_replace(text_or_empty(c), r"<[^\n]*?>", "")))


def strip_tags_full(c: Column) -> Column:
    """All tags go, entities are decoded, whitespace collapses."""
    return collapse_ws(html_decode(F.regexp_replace(text_or_empty(c), r"<[^>]+>", "")))


def summary_cut(c: Column, limit: int = 400) -> Column:
    return clip(strip_tags_full(c), limit, "...")


def build_excerpt(c: Column, limit: int = 360) -> Column:
    bare = F.regexp_replace(trim_u(text_or_empty(c)), r"<[^\n]*?>", "")
    return clip(collapse_ws(html_decode(bare)), limit, "...")


# Where the first paragraph of a page is looked for, in order.
PARAGRAPH_PATTERNS = [
    r"""(?si)<p[^>]*class=["']wp-block-paragraph["'][^>]*>(.*?)</p>""",
    r"""(?si)<div[^>]*class=["']entry-content["'][^>]*>(.*?)</div>""",
    r"""(?si)<article[^>]*>(.*?)</article>""",
    r"""(?si)<div[^>]*class=["']post-content["'][^>]*>(.*?)</div>""",
]


def first_paragraph_page(html: Column, limit: int = 800) -> Column:
    """Text of the first pattern that matches; a blank match still ends the search.

    A later pattern is tried only when all before it failed.
    """

    def search(patterns: list[str]) -> Column:
        if not patterns:
            return F.lit("")
        return let(
            F.regexp_extract(html, patterns[0], 0),
            lambda m: F.when(m != "", m).otherwise(search(patterns[1:])),
        )

    found = search(PARAGRAPH_PATTERNS)
    inner = F.regexp_extract(found, r"(?s)^<[^>]*>(.*)</[^>]*>$", 1)
    return F.coalesce(clip(strip_tags_lazy(inner), limit, "..."), F.lit(""))


def main_content_html(html: Column) -> Column:
    """The article part of a page."""
    article = r"(?si)(<article.*?)</article>"

    def marked(page: Column, head: Column) -> Column:
        """From the last `<div` before the first marker to the end of the article."""
        before = F.regexp_extract(head, r"(?si)^(.*)<div", 1)
        start = F.when(head.rlike(r"(?i)<div"), F.char_length(before)).otherwise(
            F.char_length(head)
        )
        tail = F.substring(page, F.char_length(head) + 1, F.char_length(page))
        inside = F.regexp_extract(tail, r"(?si)^(.*?)</article>", 1)

        def part(at: Column) -> Column:
            closed = F.substring(page, at + 1, F.char_length(head) + F.char_length(inside) - at)
            rest = F.substring(page, at + 1, F.char_length(page))
            return F.when(inside != "", closed).otherwise(cut_u16(rest, PAGE_SLICE))

        return let(start, part)

    def main(page: Column) -> Column:
        return (
            F.when(is_blank(page), F.lit(""))
            .when(
                page.rlike(r"(?i)entry-content"),
                let(
                    F.regexp_extract(page, r"(?si)^(.*?)entry-content", 1),
                    lambda head: marked(page, head),
                ),
            )
            .otherwise(
                let(
                    F.regexp_extract(page, article, 1),
                    lambda m: F.when(m != "", m).otherwise(cut_u16(page, PAGE_SLICE)),
                )
            )
        )

    return let(text_or_empty(html), main)


# Markup rules of the readable text, in order.
READABLE_RULES = [
    (r"(?i)<script[\s\S]*?</script>", " "),
    (r"(?i)<style[\s\S]*?</style>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?i)</(p|div|h1|h2|h3|li|br|article|section)>", "\n"),
    (r"(?i)<(br|p|div|li|h1|h2|h3|article|section)[^>]*>", "\n"),
    (r"<[^>]+>", " "),
]


def readable_text(html: Column) -> Column:
    """Markup to text that keeps line breaks."""
    out = text_or_empty(html)
    for pattern, blank in READABLE_RULES:
        out = F.regexp_replace(out, pattern, blank)
    out = F.translate(html_decode(out), "\r", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"[\t\f\x0B ]{2,}", " ")
    return cut_u16(trim_u(out), PAGE_TEXT)


def _quoted(words: list[str]) -> str:
    return "|".join(w.replace("|", r"\|") for w in words)


def drop_boilerplate_lines(text: Column, tokens: list[str] = BOILERPLATE) -> Column:
    """Lines without menu words."""
    lines = F.transform(F.split(text_or_empty(text), "\n"), trim_u)
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(f"(?i){_quoted(tokens)}"))
    return F.array_join(F.slice(kept, 1, PAGE_LINES), "\n")


def emoji_entities(c: Column) -> Column:
    """Every UTF-16 unit above 127 as a decimal entity; a surrogate pair makes two."""
    tokens = F.regexp_extract_all(c, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))

    def entity(n: Column) -> Column:
        return F.concat(F.lit("&#"), n.cast("string"), F.lit(";"))

    def unit(t: Column) -> Column:
        over = F.ascii(t) - 0x10000
        pair = F.concat(
            entity(F.shiftright(over, 10) + 0xD800), entity(F.pmod(over, F.lit(1024)) + 0xDC00)
        )
        return (
            F.when(F.ascii(t) <= 127, t).when(over < 0, entity(F.ascii(t))).otherwise(pair)
        )

    return F.when(text_or_empty(c) == "", F.lit("&#%d;" % ord(DEFAULT_EMOJI))).otherwise(
        F.array_join(F.transform(tokens, unit), "")
    )


def scrub_phrase(html: Column) -> Column:
    """Remove the unwanted phrase and up to 200 characters of text before it.

    The text is cut at each phrase and every piece but the last loses its tail; the tail is
    met from the reversed piece, so the work grows with the page only.
    """
    pattern = rf"(?i){UNWANTED_PHRASE}\.?"

    def cut(parts: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            short = F.reverse(F.regexp_replace(F.reverse(p), r"^[^<>]{1,200}", ""))
            return F.when(i < F.size(parts) - 1, short).otherwise(p)

        return F.array_join(F.transform(parts, piece), "")

    return let(F.split(html, pattern), cut)


def contains_hangul(c: Column) -> Column:
    return F.coalesce(c.rlike(r"[\x{AC00}-\x{D7A3}]"), F.lit(False))


def first_sentence_paragraph(summary: Column) -> Column:
    """The first sentence, or two when the first is short."""
    one_rx = rf"^([^\n]+?\.)(?:[{WS}]|\z)"
    two_rx = rf"^([^\n]+?\.[{WS}]+[^\n]+?\.)(?:[{WS}]|\z)"

    def pick(text: Column) -> Column:
        def widen(one: Column) -> Column:
            longer = let(
                F.regexp_extract(text, two_rx, 1), lambda two: F.when(two != "", two).otherwise(one)
            )
            short = fits_u16(one, 99) & (F.char_length(text) > F.char_length(one))
            return F.when(one == "", clip(text, 500, "...")).otherwise(
                clip(trim_u(F.when(short, longer).otherwise(one)), 600, "...")
            )

        return let(F.regexp_extract(text, one_rx, 1), widen)

    return let(trim_u(text_or_empty(summary)), pick)


def first_paragraph_chain(page_paragraph: Column, summary: Column) -> Column:
    """Page paragraph, else first sentence of the summary, else the cut summary."""
    return F.coalesce(
        F.when(~is_blank(page_paragraph), page_paragraph),
        F.nullif(first_sentence_paragraph(summary), F.lit("")),
        clip(text_or_empty(summary), 600, "..."),
    )
