"""SQL text of the text rules, for the SQL side of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from feedloom.functions.constants import (
    BANNED_LIMITS,
    BANNED_TOPIC,
    BULLETS,
    SAFE_LINES,
    UNWANTED_PAIR,
    UNWANTED_PHRASE,
    WS,
    WS_CHARS,
)

SEP = "chr(1) || chr(2) || chr(1)"
ELLIPSIS = "'…'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(quoted(x) for x in values) + "]"


def trim(x: str) -> str:
    return f"trim({x}, {quoted(WS_CHARS)})"


def collapse(x: str) -> str:
    return trim(f"regexp_replace({x}, '[{WS}]+', ' ', 'g')")


def decode(x: str) -> str:
    """The entities that occur in the given tables; the ampersand comes last."""
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, {quoted(entity)}, {quoted(char)})"
    return x


def encode(x: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = f"replace({x}, {quoted(raw)}, {quoted(entity)})"
    char = "CASE WHEN unicode(c) BETWEEN 160 AND 255 OR unicode(c) > 65535 THEN '&#' || unicode(c) || ';' ELSE c END"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: {char}), '')"


def let(value: str, name: str, body: str) -> str:
    return f"(list_transform([{value}], lambda {name}: {body})[1])"


def clip(x: str, limit: int, tail: str) -> str:
    return let(
        x, "cl", f"CASE WHEN length(cl) <= {limit} THEN cl ELSE left(cl, {limit}) || {quoted(tail)} END"
    )


def sentences(x: str, stops: str) -> str:
    """Text cut behind each stop that blanks follow."""
    marked = f"regexp_replace({x}, '([{stops}])[{WS}]+', '\\1' || {SEP}, 'g')"
    return f"list_transform(string_split({marked}, {SEP}), lambda s: {trim('s')})"


def strip_full(x: str) -> str:
    return collapse(decode(f"regexp_replace({x}, '<[^>]+>', '', 'g')"))


def strip_lazy(x: str) -> str:
    return trim(decode(f"regexp_replace({x}, '<[^\\n]*?>', '', 'g')"))


def sanitize_bullet(x: str) -> str:
    return let(
        trim(f"coalesce({x}, '')"),
        "sb",
        f"CASE WHEN starts_with(sb, '(번역 미구성)') THEN {trim('substr(sb, 9)')} ELSE sb END",
    )


def normalize_bullets(x: str, fillers: list[str]) -> str:
    clean = f"list_filter(list_transform({x}, lambda b: {sanitize_bullet('b')}), lambda b: b <> '')"
    return f"list_concat({clean}, {listed(fillers)})[1:3]"


def _before(x: str, blanks: str) -> str:
    return f"regexp_extract({x}, '(?s)^(.*)[{blanks}]', 1)"


def _clip_sentence(s: str) -> str:
    cut = let(
        f"left({s}, 300)",
        "c3",
        let(_before("c3", r" \t\n\r"), "p3", "CASE WHEN length(p3) > 150 THEN p3 ELSE c3 END"),
    )
    return f"CASE WHEN length({s}) <= 300 THEN {s} ELSE rtrim({cut}, {quoted(WS_CHARS)}) || {ELLIPSIS} END"


def excerpt_lines(x: str, count: int) -> str:
    """The fold keeps the rest of the text in front of the lines."""
    whole = let(
        _before("ch", r" \t\n\r"),
        "pc",
        f"CASE WHEN length(pc) > 120 AND length(pc) < length(ch) - 1 THEN {trim('pc')} ELSE ch END",
    )
    line = f"{whole} || CASE WHEN rs <> '' THEN {ELLIPSIS} ELSE '' END"
    step = let(
        trim("left(a[1], 300)"),
        "ch",
        let(trim("substr(a[1], 301)"), "rs", f"list_append(list_prepend(rs, a[2:]), {line})"),
    )
    fold = (
        f"list_reduce({listed([''] * count)}, lambda a, z: CASE WHEN len(a) <= {count} AND a[1] <> ''"
        f" THEN {step} ELSE a END, list_prepend(tx, fl))[2:]"
    )
    parts = f"list_filter({sentences('tx', '.!?。！？')}, lambda s: s <> '')[1:{count}]"
    first = f"list_transform({parts}, lambda s: {_clip_sentence('s')})"
    lines = let(first, "fl", f"CASE WHEN len(fl) >= {count} THEN fl ELSE {fold} END")
    return let(
        trim(f"coalesce({x}, '')"), "tx", f"CASE WHEN tx = '' THEN []::VARCHAR[] ELSE {lines} END"
    )


def chunk_lines(x: str, count: str, limit: int, most: int) -> str:
    piece = trim("CASE WHEN length(pp) > greatest(80, length(hd) // 3) THEN pp ELSE hd END")
    taken = "least(length(hd), greatest(1, length(pi) + (length(pi) < length(a[1]))::INT))"
    line = f"CASE WHEN length(pi) < length(a[1]) THEN pi || {ELLIPSIS} ELSE pi END"
    step = let(
        f"left(a[1], {limit})",
        "hd",
        let(
            _before("hd", " "),
            "pp",
            let(piece, "pi", f"list_append(list_prepend(substr(a[1], {taken} + 1), a[2:]), {line})"),
        ),
    )
    return (
        f"list_reduce({listed([''] * most)}, lambda a, z: CASE WHEN len(a) <= {count} AND a[1] <> ''"
        f" THEN {step} ELSE a END, [{collapse(f'coalesce({x}, {quoted("")})')}])[2:]"
    )


def same(a: str, b: str) -> str:
    return f"lower({a}) = lower({b})"


def overlap(a: str, b: str) -> str:
    return f"(contains(lower({a}), lower({b})) OR contains(lower({b}), lower({a})))"


def add_lines(lines: str, more: str, clash: Callable[[str, str], str], count: int = 3) -> str:
    return (
        f"list_reduce({more}, lambda ac, x: CASE WHEN len(ac) < {count} AND "
        f"len(list_filter(ac, lambda r: {clash('r', 'x')})) = 0 "
        f"THEN list_append(ac, x) ELSE ac END, {lines})"
    )


def distinct_nocase(lines: str, count: int = 3) -> str:
    return add_lines("[]::VARCHAR[]", lines, same, count)


def _plain(x: str) -> str:
    bare = f"regexp_replace(coalesce({x}, ''), '^[{WS}{BULLETS}\\-*]+', '')"
    return f"lower(replace({bare}, {ELLIPSIS}, '...'))"


def unwanted(x: str) -> str:
    one, two = (quoted(p) for p in UNWANTED_PAIR)
    return let(
        _plain(x),
        "lw",
        f"contains(lw, {quoted(UNWANTED_PHRASE)}) OR (contains(lw, {one}) AND contains(lw, {two}))",
    )


def banned(x: str) -> str:
    limits = " OR ".join(f"contains(lw, {quoted(p)})" for p in BANNED_LIMITS)
    return let(_plain(x), "lw", f"contains(lw, {quoted(BANNED_TOPIC)}) AND ({limits})")


def allowed(x: str) -> str:
    return f"(NOT {unwanted(x)} AND NOT {banned(x)})"


def keep(lines: str, cond: str) -> str:
    """Elements `k` of a list for which `cond` holds."""
    return f"list_filter({lines}, lambda k: {cond})"


def each(lines: str, body: str) -> str:
    """`body` of each element `e` of a list."""
    return f"list_transform({lines}, lambda e: {body})"


def strip_marker(x: str) -> str:
    one = f"regexp_replace({trim(f'coalesce({x}, {quoted("")})')}, '^[{WS}]*[-*{BULLETS}][{WS}]+', '')"
    return trim(f"regexp_replace({one}, '^[{WS}]*\\p{{Nd}}+[{WS}]*[.|)][{WS}]+', '')")


def punctuation(x: str) -> str:
    plain = f"translate(coalesce({x}, ''), '‘’“”–—', '''''\"\"--')"
    return collapse(f"replace({plain}, {ELLIPSIS}, '...')")


def clean_point(x: str) -> str:
    bare = f"regexp_replace(coalesce({x}, ''), '[{BULLETS}·â€¢]', '', 'g')"
    return f"replace({collapse(bare)}, {ELLIPSIS}, '...')"


def three_insights(points: str, lines: str) -> str:
    own = keep(each(points, strip_marker("e")), "k <> ''")
    more = each(f"{lines}[1:6]", trim("e"))
    return add_lines(add_lines(distinct_nocase(own), more, overlap), f"{lines}[1:3]", same)


def exactly_three(given: str, lines: str, fallback: str) -> str:
    clean = keep(distinct_nocase(keep(given, f"{trim('k')} <> ''"), 1000), allowed("k"))

    def usable(more: str) -> str:
        return keep(each(more, trim("e")), f"k <> '' AND {allowed('k')}")

    chunks = usable(chunk_lines(fallback, "6", 160, 6))
    return let(
        clean,
        "l1",
        let(
            f"CASE WHEN len(l1) >= 3 THEN l1 ELSE {add_lines('l1', usable(lines), overlap)} END",
            "l2",
            let(
                f"CASE WHEN len(l2) >= 3 THEN l2 ELSE {add_lines('l2', chunks, overlap)} END",
                "l3",
                f"list_concat({add_lines('l3', listed(SAFE_LINES), same)}, ['', '', ''])[1:3]",
            ),
        ),
    )


def joined(lines: str) -> str:
    return f"array_to_string({lines}, ' ¦ ')"
