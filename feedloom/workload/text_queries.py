"""Text rules on documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import html as htm
from feedloom.functions import lines as lns
from feedloom.functions import text as txt
from feedloom.functions.constants import (
    BLANK_SUMMARY_BULLETS,
    BOILERPLATE,
    DEFAULT_EMOJI,
    EN_FILLERS,
    KO_UNAVAILABLE,
    UNWANTED_PHRASE,
    WS,
)
from feedloom.functions.dates import display_day_ko, display_minute, format_iso, parse_pubdate
from feedloom.functions.keys import partition_key, row_key
from feedloom.plans import mail
from feedloom.workload import sqltext as q
from feedloom.workload import views as v
from feedloom.workload.registry import query
from feedloom.workload.sqltext import joined, let, quoted
from feedloom.workload.views import DOCUMENTS_SQL, ISO, RK_SQL

C = F.col
GLUE = " ¦ "


def glue(lines):
    return F.array_join(lines, GLUE)


def doc_query(name: str, sql: str, table: str, key: str, column):
    """A query of one text column `out` per row of a table."""

    @query(name, f"SELECT {key}, {sql} AS out FROM {table}")
    def _(spark, sf):
        return v.texts(spark, sf, table).select(key, column().alias("out"))


def documents_query(name: str, sql: str, column) -> None:
    doc_query(name, sql, "documents", "doc_id", column)


def pages_query(name: str, sql: str, column) -> None:
    doc_query(name, sql, "pages", "page_id", column)


# --- markup ------------------------------------------------------------------------------

pages_query("t1_strip_tags_lazy", q.strip_lazy("html"), lambda: htm.strip_tags_lazy(C("html")))
pages_query("t2_strip_tags_full", q.strip_full("html"), lambda: htm.strip_tags_full(C("html")))
pages_query("t4_html_decode", q.decode("html"), lambda: htm.html_decode(C("html")))
documents_query("t5_html_encode", q.encode("text"), lambda: htm.html_encode(C("text")))
pages_query("t5_html_encode_pages", q.encode("html"), lambda: htm.html_encode(C("html")))
pages_query(
    "t11_build_excerpt",
    q.clip(
        q.collapse(q.decode(f"regexp_replace({q.trim('html')}, '<[^\\n]*?>', '', 'g')")), 360, "..."
    ),
    lambda: htm.build_excerpt(C("html")),
)
pages_query(
    "t38_summary_cut",
    q.clip(q.strip_full("html"), 400, "..."),
    lambda: htm.summary_cut(C("html")),
)

VARIANT_SQL = """
variants AS (
  SELECT page_id, url, CASE page_id % 4
    WHEN 1 THEN replace(html, '<p>', '<P id="x" class="wp-block-paragraph">')
    WHEN 2 THEN replace(replace(html, '<article>', '<div class="entry-content">'), '</article>', '</div>')
    WHEN 3 THEN replace(replace(html, '<article>', '<div class=''post-content''>'), '</article>', '</div>')
    ELSE html END AS html FROM pages)"""


def variants(spark, sf):
    """Pages in the layouts that the paragraph search knows."""
    page, n = C("html"), C("page_id") % 4

    def swap(tag):
        opened = F.replace(page, F.lit("<article>"), F.lit(tag))
        return F.replace(opened, F.lit("</article>"), F.lit("</div>"))

    html = (
        F.when(n == 1, F.replace(page, F.lit("<p>"), F.lit('<P id="x" class="wp-block-paragraph">')))
        .when(n == 2, swap('<div class="entry-content">'))
        .when(n == 3, swap("<div class='post-content'>"))
        .otherwise(page)
    )
    return v.texts(spark, sf, "pages").select(
        "page_id", "url", F.lit(200).alias("status"), html.alias("html")
    )


def _paragraph_sql() -> str:
    cases = " ".join(
        f"WHEN regexp_matches(html, {quoted(p)}) THEN regexp_extract(html, {quoted(p)}, 1)"
        for p in htm.PARAGRAPH_PATTERNS
    )
    return q.clip(q.strip_lazy(f"CASE {cases} ELSE '' END"), 800, "...")


@query(
    "t3_first_paragraph_page",
    f"WITH {VARIANT_SQL} SELECT page_id, {_paragraph_sql()} AS out FROM variants",
)
def _(spark, sf):
    return variants(spark, sf).select("page_id", htm.first_paragraph_page(C("html")).alias("out"))


MAIN_SQL = f"""{VARIANT_SQL},
marks AS (
  SELECT page_id, url, html, strpos(lower(html), 'entry-content') AS i,
    strpos(lower(html), '<article') AS a FROM variants),
starts AS (
  SELECT *, CASE WHEN contains(lower(left(html, i - 1)), '<div')
    THEN length(regexp_extract(left(html, i - 1), '(?si)^(.*)<div', 1)) ELSE i - 1 END AS s,
    strpos(lower(substr(html, i)), '</article>') AS e,
    strpos(lower(substr(html, a)), '</article>') AS ae FROM marks),
mains AS (
  SELECT page_id, url, html, CASE WHEN i > 0 AND e > 0 THEN substr(html, s + 1, i - 1 + e - 1 - s)
    WHEN i > 0 THEN substr(html, s + 1, 60000)
    WHEN a > 0 AND ae > 0 THEN substr(html, a, ae - 1) ELSE left(html, 60000) END AS main FROM starts)"""


@query("t15_main_content_html", f"WITH {MAIN_SQL} SELECT page_id, main AS out FROM mains")
def _(spark, sf):
    return variants(spark, sf).select("page_id", htm.main_content_html(C("html")).alias("out"))


def _readable_sql(x: str) -> str:
    for pattern, blank in htm.READABLE_RULES:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(blank)}, 'g')"
    x = f"replace({q.decode(x)}, chr(13), chr(10))"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"left({q.trim(f'regexp_replace({x}, {quoted("[\\t\\f\\x0B ]{2,}")}, {quoted(" ")}, {quoted("g")})')}, 8000)"


def _clean_lines_sql(x: str) -> str:
    words = " OR ".join(f"contains(lower(k), {quoted(w.lower())})" for w in BOILERPLATE)
    lines = q.each(f"string_split({x}, chr(10))", q.trim("e"))
    kept = q.keep(lines, f"k <> '' AND NOT ({words})")
    return f"array_to_string({kept}[1:200], chr(10))"


ARTICLE_SQL = f"""{MAIN_SQL},
texts AS (SELECT page_id, url, html, {_readable_sql("main")} AS t FROM mains),
articles AS (SELECT page_id, url, html, {_clean_lines_sql("t")} AS article_text FROM texts)"""


@query("t16_readable_text", f"WITH {ARTICLE_SQL} SELECT page_id, t AS out FROM texts")
def _(spark, sf):
    mains = variants(spark, sf).withColumn("main", htm.main_content_html(C("html")))
    return mains.select("page_id", htm.readable_text(C("main")).alias("out"))


@query(
    "t17_drop_boilerplate_lines",
    f"WITH {ARTICLE_SQL} SELECT page_id, article_text AS out FROM articles",
)
def _(spark, sf):
    return mail.page_text(variants(spark, sf)).select("page_id", C("article_text").alias("out"))


# --- paragraphs and bullets --------------------------------------------------------------


def _sentence_sql(x: str) -> str:
    one = f"'^([^\\n]+?\\.)(?:[{WS}]|\\z)'"
    two = f"'^([^\\n]+?\\.[{WS}]+[^\\n]+?\\.)(?:[{WS}]|\\z)'"
    pick = let(
        q.trim(f"regexp_extract(tx, {two}, 1)"),
        "tw",
        "CASE WHEN length(on1) < 100 AND length(tx) > length(on1) AND tw <> '' THEN tw ELSE on1 END",
    )
    found = q.clip(let(q.trim(f"regexp_extract(tx, {one}, 1)"), "on1", pick), 600, "...")
    return let(
        q.trim(x),
        "tx",
        f"CASE WHEN regexp_matches(tx, {one}) THEN {found} ELSE {q.clip('tx', 500, '...')} END",
    )


documents_query(
    "t6_first_sentence_paragraph",
    _sentence_sql("text"),
    lambda: htm.first_sentence_paragraph(C("text")),
)
documents_query(
    "t7_first_paragraph_chain",
    f"CASE WHEN lang = 'fr' THEN split_part(text, chr(10), 1) ELSE {_sentence_sql('text')} END",
    lambda: htm.first_paragraph_chain(
        F.when(C("lang") == "fr", F.split_part("text", F.lit("\n"), F.lit(1))).when(
            C("lang") == "de", F.lit("  ")
        ),
        C("text"),
    ),
)


def bullets_sql(x: str) -> str:
    long_parts = q.keep(q.sentences("tx", ".!?"), "length(k) >= 20") + "[1:3]"
    some = let(
        long_parts,
        "lp",
        "CASE WHEN len(lp) > 0 THEN "
        + q.each("lp", q.clip("e", 160, "..."))
        + f" ELSE [{q.clip('tx', 140, '...')}] END",
    )
    return let(
        q.trim(x),
        "tx",
        f"CASE WHEN tx = '' THEN {q.listed(BLANK_SUMMARY_BULLETS)} "
        f"ELSE {q.normalize_bullets(some, EN_FILLERS)} END",
    )


documents_query(
    "t8_extract_bullets",
    joined(bullets_sql("text")),
    lambda: glue(lns.extract_bullets(C("text"))),
)

TITLE_SQL = "split_part(text, chr(10), 1)"


def _title():
    return F.split_part("text", F.lit("\n"), F.lit(1))


GIVEN_SQL = f"""CASE lang WHEN 'fr' THEN ['  ', '(번역 미구성) ' || {TITLE_SQL}, lang]
  WHEN 'de' THEN [{TITLE_SQL}, lang, source, text] ELSE [' - '] END"""


def _given():
    return (
        F.when(
            C("lang") == "fr",
            F.array(F.lit("  "), F.concat(F.lit("(번역 미구성) "), _title()), C("lang")),
        )
        .when(C("lang") == "de", F.array(_title(), C("lang"), C("source"), C("text")))
        .otherwise(F.array(F.lit(" - ")))
    )


documents_query(
    "t9_normalize_bullets",
    joined(q.normalize_bullets(GIVEN_SQL, EN_FILLERS)),
    lambda: glue(lns.normalize_bullets(_given())),
)
documents_query(
    "t10_sanitize_bullet",
    q.sanitize_bullet(f"CASE WHEN lang = 'fr' THEN ' (번역 미구성) ' || text ELSE text END"),
    lambda: lns.sanitize_bullet(
        F.when(C("lang") == "fr", F.concat(F.lit(" (번역 미구성) "), C("text"))).otherwise(C("text"))
    ),
)


@query("t12_contains_hangul", "SELECT doc_id, lang = 'fr' AS out FROM documents")
def _(spark, sf):
    mixed = F.when(C("lang") == "fr", F.concat(C("text"), F.lit(" 한"))).otherwise(C("text"))
    return v.texts(spark, sf, "documents").select("doc_id", htm.contains_hangul(mixed).alias("out"))


@query(
    "t13_partition_key",
    """SELECT doc_id, CASE WHEN lang = 'fr' THEN 'Unknown' ELSE source || 'x' || lang END AS out
FROM documents""",
)
def _(spark, sf):
    name = F.when(C("lang") != "fr", F.concat_ws(" ", "source", F.lit("x"), "lang"))
    return v.texts(spark, sf, "documents").select("doc_id", partition_key(name).alias("out"))


@query("t14_row_key", f"WITH {DOCUMENTS_SQL} SELECT item_pos, {RK_SQL} AS out FROM docs")
def _(spark, sf):
    return v.documents(spark, sf).select("item_pos", row_key(C("link")).alias("out"))


# --- lines -------------------------------------------------------------------------------

for _n in (3, 8):
    documents_query(
        f"t18_excerpt_lines_{_n}",
        joined(q.excerpt_lines("text", _n)),
        lambda n=_n: glue(lns.excerpt_lines(C("text"), n)),
    )

PHRASED_SQL = f"""CASE lang WHEN 'fr' THEN ' • But {UNWANTED_PHRASE}… ' || {TITLE_SQL}
  WHEN 'de' THEN '- a point solution is holding you back: ' || {TITLE_SQL} ELSE text END"""


def _phrased():
    return (
        F.when(C("lang") == "fr", F.concat(F.lit(f" • But {UNWANTED_PHRASE}… "), _title()))
        .when(
            C("lang") == "de", F.concat(F.lit("- a point solution is holding you back: "), _title())
        )
        .otherwise(C("text"))
    )


documents_query(
    "t19_drop_lines_in_summary",
    joined(
        let(
            q.excerpt_lines("text", 6),
            "ls",
            q.keep(
                q.each("ls", q.trim("e")),
                f"k <> '' AND NOT contains(lower({q.clip(q.collapse('text'), 400, '...')}), lower(k))",
            ),
        )
    ),
    lambda: glue(
        lns.drop_lines_in_summary(lns.excerpt_lines(C("text"), 6), htm.summary_cut(C("text")))
    ),
)


@query(
    "t20_unwanted_sentence",
    f"SELECT doc_id, {q.unwanted(PHRASED_SQL)} AS out FROM documents",
)
def _(spark, sf):
    return v.texts(spark, sf, "documents").select(
        "doc_id", lns.unwanted_sentence(_phrased()).alias("out")
    )


@query("t21_banned_variant", f"SELECT doc_id, {q.banned(PHRASED_SQL)} AS out FROM documents")
def _(spark, sf):
    return v.texts(spark, sf, "documents").select(
        "doc_id", lns.banned_variant(_phrased()).alias("out")
    )


documents_query(
    "t22_chunk_lines",
    joined(q.chunk_lines("text", "6", 160, 6)),
    lambda: glue(lns.chunk_lines(C("text"), 6, 160)),
)

MARKED_SQL = f"""CASE lang WHEN 'fr' THEN ' • ' || text WHEN 'de' THEN '12) ' || text
  WHEN 'es' THEN '- 3 . ' || text ELSE text END"""


def _marked():
    text = C("text")
    return (
        F.when(C("lang") == "fr", F.concat(F.lit(" • "), text))
        .when(C("lang") == "de", F.concat(F.lit("12) "), text))
        .when(C("lang") == "es", F.concat(F.lit("- 3 . "), text))
        .otherwise(text)
    )


documents_query(
    "t24_strip_bullet_marker",
    q.strip_marker(MARKED_SQL),
    lambda: lns.strip_bullet_marker(_marked()),
)

QUOTED_SQL = "replace(replace(text, ', ', ' “–” '), '. ', '…  ‘')"


def _curly():
    return F.replace(
        F.replace(C("text"), F.lit(", "), F.lit(" “–” ")), F.lit(". "), F.lit("…  ‘")
    )


documents_query(
    "t27_normalize_punctuation",
    q.punctuation(QUOTED_SQL),
    lambda: lns.normalize_punctuation(_curly()),
)
documents_query(
    "t28_clean_point",
    q.clean_point("replace(replace(text, ', ', ' • '), '. ', '… ')"),
    lambda: lns.clean_point(
        F.replace(F.replace(C("text"), F.lit(", "), F.lit(" • ")), F.lit(". "), F.lit("… "))
    ),
)

# --- excerpts and insights of a mail ------------------------------------------------------


def mail_posts(spark, sf):
    """Documents as posts; a document with the number of a page links to that page."""
    docs = v.texts(spark, sf, "documents")
    pages = v.table(spark, sf, "pages").select(C("page_id").alias("doc_id"), "url")
    lang, title = C("lang"), _title()
    en = F.when(lang == "fr", F.array(F.concat(F.lit("• “"), title, F.lit("”")), lang, lang)).when(
        lang == "en", F.array(F.lit(" "), F.lit(f"1. But {UNWANTED_PHRASE}."), title)
    )
    ko = F.when(
        lang == "fr", F.array(F.lit("- 한국어"), F.concat(title, F.lit(" 요약")), F.lit("- 한국어"))
    ).when(lang == "es", F.array(title))
    return docs.join(pages, "doc_id", "left").select(
        "doc_id",
        F.upper("url").alias("link"),
        title.alias("title"),
        F.concat(F.lit("<p>"), C("text"), F.lit("</p>")).alias("summary"),
        C("source").alias("source_name"),
        F.lit(None).cast("string").alias("emoji"),
        F.when(C("doc_id") % 5 > 0, F.timestamp_seconds(C("doc_id") * 86400 + 1700000000)).alias("published"),
        en.alias("english_summary"),
        ko.alias("korean_summary"),
    )


MAILS_SQL = f"""
mails AS (
  SELECT doc_id, upper(p.url) AS link, {TITLE_SQL} AS title, '<p>' || text || '</p>' AS summary,
    source AS source_name,
    CASE WHEN doc_id % 5 > 0 THEN TIMESTAMP '2023-11-14 22:13:20' + INTERVAL 1 DAY * doc_id END AS published,
    CASE lang WHEN 'fr' THEN ['• “' || {TITLE_SQL} || '”', lang, lang]
      WHEN 'en' THEN [' ', '1. But {UNWANTED_PHRASE}.', {TITLE_SQL}] ELSE [] END AS english,
    CASE lang WHEN 'fr' THEN ['- 한국어', {TITLE_SQL} || ' 요약', '- 한국어'] END AS korean
  FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id)"""
LINES_SQL = f"""
bylink AS (SELECT lower(url) AS k, arg_min(article_text, md5(html)) AS article_text FROM articles GROUP BY 1),
sums AS (
  SELECT m.*, b.article_text, {q.strip_full("summary")} AS full_text,
    {q.clip(q.strip_full("summary"), 400, "...")} AS summary_text
  FROM mails m LEFT JOIN bylink b ON lower(m.link) = b.k),
page_lines AS (
  SELECT *, {q.keep(q.each(q.excerpt_lines("article_text", 3), q.trim("e")),
      f"NOT {q.unwanted('k')} AND (summary_text = '' OR NOT contains(lower(summary_text), lower(k)))")}
    AS l0 FROM sums),
topped AS (
  SELECT *, CASE WHEN len(l0) >= 3 THEN l0 ELSE {q.add_lines(
      "l0", q.keep(q.excerpt_lines("summary_text", 6), f"NOT {q.unwanted('k')}"), q.same)} END AS l1
  FROM page_lines),
excerpts AS (
  SELECT *, CASE WHEN len(l1) >= 3 THEN l1[1:3] ELSE list_concat(l1, {q.keep(
      q.chunk_lines("summary_text", "(3 - len(l1))", 300, 3), f"NOT {q.unwanted('k')}")})[1:3] END
    AS excerpt FROM topped),
fallbacks AS (
  SELECT *, CASE WHEN coalesce(article_text, '') <> '' THEN article_text WHEN full_text <> ''
    THEN full_text ELSE array_to_string(excerpt, ' ') END AS fallback FROM excerpts),
lined AS MATERIALIZED (SELECT *, {q.excerpt_lines("fallback", 8)} AS l8 FROM fallbacks)"""

MAIL_SQL = f"{ARTICLE_SQL}, {MAILS_SQL}, {LINES_SQL}"

_EN_POINTS = q.keep(
    q.each(q.keep("english", f"{q.trim('k')} <> ''"), q.punctuation("e")), f"NOT {q.unwanted('k')}"
)


def _insights_sql(points: str) -> str:
    three = q.keep(q.three_insights(points, "l8"), q.allowed("k"))
    return q.exactly_three(three, "l8", "fallback")


EN_SQL = _insights_sql(_EN_POINTS)
KO_SQL = f"""CASE WHEN korean IS NOT NULL THEN {_insights_sql("korean")}
  ELSE [{quoted(KO_UNAVAILABLE[0])}, {quoted(KO_UNAVAILABLE[1])},
    CASE WHEN coalesce(link, '') = '' THEN {quoted(KO_UNAVAILABLE[2] + ".")}
      ELSE {quoted(KO_UNAVAILABLE[2] + ": ")} || link END] END"""


def mail_lines(spark, sf):
    return mail.mail_lines(mail_posts(spark, sf), mail.article_text(variants(spark, sf)))


def mail_query(name: str, sql: str, column: str, lines: bool = True) -> None:
    out = joined(sql) if lines else sql

    @query(name, f"WITH {MAIL_SQL} SELECT doc_id, {out} AS out FROM lined")
    def _(spark, sf):
        found = C(column)
        return mail_lines(spark, sf).select("doc_id", (glue(found) if lines else found).alias("out"))


#: More banned lines than an excerpt has lines, before any good one.
BANNED_LINES = [f"Point solutions may hold you back, part {i}" for i in range(9)]

mail_query("j7_insight_text_source", "fallback", "fallback", lines=False)
mail_query("t23_excerpt_three", "excerpt", "excerpt")
mail_query("t29_insights_en", EN_SQL, "en")
mail_query("t30_insights_ko", KO_SQL, "ko")

documents_query(
    "t25_three_insights",
    joined(let(q.excerpt_lines("text", 8), "l8", q.three_insights(GIVEN_SQL, "l8"))),
    lambda: glue(lns.three_insights(_given(), lns.excerpt_lines(C("text"), 8))),
)
documents_query(
    "t26_exactly_three_insights",
    joined(
        let(
            q.excerpt_lines("text", 8),
            "l8",
            q.exactly_three(f"list_concat({q.listed(BANNED_LINES)}, {GIVEN_SQL})", "l8", "text"),
        )
    ),
    lambda: glue(
        lns.exactly_three_insights(
            F.concat(txt.lits(BANNED_LINES), _given()), lns.excerpt_lines(C("text"), 8), C("text")
        )
    ),
)

# --- small scalars -----------------------------------------------------------------------

UNIT_SQL = """CASE WHEN unicode(c) > 65535 THEN '&#' || (55296 + (unicode(c) - 65536) // 1024) || ';&#'
    || (56320 + (unicode(c) - 65536) % 1024) || ';' WHEN unicode(c) > 127
    THEN '&#' || unicode(c) || ';' ELSE c END"""
documents_query(
    "t31_emoji_entities",
    f"""CASE WHEN lang = 'es' THEN '&#{ord(DEFAULT_EMOJI)};' ELSE array_to_string(list_transform(
  regexp_extract_all('🛡️' || text, '(?s).'), lambda c: {UNIT_SQL}), '') END""",
    lambda: htm.emoji_entities(
        F.when(C("lang") == "es", "").otherwise(F.concat(F.lit("🛡️"), C("text")))
    ),
)


@query(
    "t32_truncate_log",
    f"""SELECT doc_id, {q.clip("replace(replace(text, chr(13), ' '), chr(10), ' ')", 400, "...")} AS out,
  {q.clip("text", 1000, "...[truncated]")} AS long_out FROM documents""",
)
def _(spark, sf):
    return v.texts(spark, sf, "documents").select(
        "doc_id",
        txt.truncate_log(C("text")).alias("out"),
        txt.truncate_log_long(C("text")).alias("long_out"),
    )


documents_query(
    "t36_scrub_phrase",
    f"""regexp_replace('<p>' || text || ' Point solutions can only go so far. ' || text || '</p>',
  '(?is)[^<>]{{0,200}}?{UNWANTED_PHRASE}\\.?[^<>]{{0,200}}?', '', 'g')""",
    lambda: htm.scrub_phrase(
        F.concat(
            F.lit("<p>"),
            C("text"),
            F.lit(" Point solutions can only go so far. "),
            C("text"),
            F.lit("</p>"),
        )
    ),
)

# --- dates -------------------------------------------------------------------------------


@query(
    "d1_parse_pubdate",
    f"""SELECT event_id, CASE WHEN event_type <> 'error' THEN strftime(ts, {ISO}) END AS out
FROM events""",
)
def _(spark, sf):
    kind, ts = C("event_type"), C("ts")
    east = F.expr("ts + INTERVAL 9 HOURS")
    raw = (
        F.when(kind == "click", F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss 'GMT'"))
        .when(kind == "view", F.concat(F.date_format(east, "dd MMM yyyy HH:mm:ss"), F.lit(" +0900")))
        .when(kind == "signup", F.concat(F.date_format(east, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00")))
        .when(
            kind == "purchase",
            F.concat(F.date_format(F.expr("ts - INTERVAL 8 HOURS"), "EEE, dd MMM yy HH:mm:ss"), F.lit(" PST")),
        )
        .otherwise(C("props"))
    )
    return v.events(spark, sf).select("event_id", format_iso(parse_pubdate(raw)).alias("out"))


@query("d2_format_iso", f"SELECT event_id, strftime(ts, {ISO}) AS out FROM events")
def _(spark, sf):
    return v.events(spark, sf).select("event_id", format_iso(C("ts")).alias("out"))


@query(
    "d3_display_date",
    """SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS out,
  strftime(ts, '%Y년 %m월 %d일') AS korean FROM events""",
)
def _(spark, sf):
    return v.events(spark, sf).select(
        "event_id", display_minute(C("ts")).alias("out"), display_day_ko(C("ts")).alias("korean")
    )


@query(
    "d4_bin_hour_ago",
    f"""SELECT strftime(date_trunc('hour', ts), {ISO}) AS bin, count(*) AS n FROM events
WHERE ts > {v.AS_OF_SQL} - INTERVAL 36 HOUR GROUP BY 1""",
)
def _(spark, sf):
    from feedloom.functions.dates import ago, bin_hour

    recent = v.events(spark, sf).filter(C("ts") > ago(v.as_of(), days=1, hours=12))
    return recent.groupBy(format_iso(bin_hour(C("ts"))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
