"""Model exchange, lenient JSON and rendered pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import json_cols as jsn
from feedloom.functions.constants import (
    DEFAULT_EMOJI,
    ERROR_NO_HANGUL,
    KO_CARD_FILLERS,
    KO_FILLERS,
    LABELS,
    MISSING_EN,
    MISSING_KO,
    PLACEHOLDER_TITLES,
    SUBJECT_NEW,
    SUBJECT_NONE,
)
from feedloom.functions.dates import format_iso
from feedloom.operators import insights as ins
from feedloom.operators.filters import is_new
from feedloom.operators import posts as pst
from feedloom.operators import render as rnd
from feedloom.operators import status as sts
from feedloom.plans import digest as dig
from feedloom.plans import mail
from feedloom.session import settle, shared_dir
from feedloom.sources.tables import read_digests, write_digests
from feedloom.workload import sqltext as q
from feedloom.workload import tables_queries as tbq
from feedloom.workload import text_queries as txq
from feedloom.workload import views as v
from feedloom.workload.registry import SQL, query
from feedloom.workload.sqltext import joined, quoted
from feedloom.workload.tables_queries import CHOICE_SQL, STATES_SQL
from feedloom.workload.text_queries import GLUE, TITLE_SQL, bullets_sql, glue

C = F.col


def _title():
    return F.split_part("text", F.lit("\n"), F.lit(1))


# --- posts and requests in JSON ----------------------------------------------------------


def requests(spark, sf):
    """One request per document with its whole text, in the spellings and list forms that callers use."""
    title, lang = C("text"), C("lang")
    lists = F.to_json(F.array(title, lang))
    camel = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    title.alias("title"),
                    C("source").alias("sourceName"),
                    F.array(title, lang).alias("englishSummary"),
                    lists.alias("koreanSummary"),
                )
            ).alias("posts")
        )
    )
    pascal = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    title.alias("Title"),
                    C("source").alias("SourceName"),
                    title.alias("EnglishSummary"),
                    F.lit(7).alias("KoreanSummary"),
                )
            ).alias("Posts")
        )
    )
    return v.texts(spark, sf, "documents").select(
        C("doc_id").alias("request_id"), F.when(lang == "fr", pascal).otherwise(camel).alias("body")
    )


@query(
    "n1_string_array_lenient",
    f"""SELECT doc_id AS request_id, CASE WHEN lang = 'fr' THEN text
    ELSE text || {quoted(GLUE)} || lang END AS english,
  CASE WHEN lang <> 'fr' THEN text || {quoted(GLUE)} || lang END AS korean FROM documents""",
)
def _(spark, sf):
    posts = mail.posts_from_requests(requests(spark, sf))
    return posts.select(
        "request_id", glue("english_summary").alias("english"), glue("korean_summary").alias("korean")
    )


@query(
    "n2_field_any_case",
    "SELECT doc_id AS request_id, text AS title, source AS source_name FROM documents",
)
def _(spark, sf):
    return mail.posts_from_requests(requests(spark, sf)).select("request_id", "title", "source_name")


# --- model exchange ----------------------------------------------------------------------


def display(spark, sf):
    """Display posts of all runs with title, text and bullets."""
    posts = v.posts(spark, sf).withColumn("emoji", F.lit(None).cast("string"))
    chosen = tbq.choice(spark, sf)
    return chosen, settle(dig.with_text(chosen.shown, posts), "display")


def _display_sql(emoji: str) -> str:
    return f"""display AS (
  SELECT s.digest_id, s.rank, s.is_new_post, s.as_of, p.item_pos, p.title, p.link, p.summary, p.source_name,
    p.published, {emoji} AS emoji, {bullets_sql("p.summary")} AS bullets
  FROM shown s JOIN posts p USING (item_pos))"""


DISPLAY_SQL = f"{CHOICE_SQL},\n{_display_sql(quoted(DEFAULT_EMOJI))}"


@query(
    "n3_model_request",
    f"""WITH {DISPLAY_SQL}
SELECT digest_id, rank - 1 AS index, title, {joined("bullets")} AS bullets FROM display
WHERE rank <= 10""",
)
def _(spark, sf):
    """Requests read back: the payload itself is JSON text."""
    _, posts = display(spark, sf)
    sent = ins.model_requests(pst.translation_slice(posts))
    schema = "items ARRAY<STRUCT<index: BIGINT, title: STRING, englishSummary: ARRAY<STRING>>>"
    items = sent.select("digest_id", F.explode(F.from_json("payload", schema)["items"]).alias("i"))
    return items.select(
        "digest_id", "i.index", "i.title", glue("i.englishSummary").alias("bullets")
    )


def answers(posts):
    """A model answer per digest, in one of several shapes, made from its posts.

    Per post: an item with two Korean lines, after an older one with the same index.
    """
    first = F.struct(
        C("index").cast("int").alias("index"), F.array(F.lit("옛 요약")).alias("koreanSummary")
    )
    second = F.struct(
        C("index").cast("int").alias("index"),
        F.array(F.concat(F.lit("핵심 "), C("title")), F.lit(""), F.lit("(번역 미구성) 둘")).alias(
            "koreanSummary"
        ),
    )
    stray = F.array(
        F.struct(F.lit(-1).alias("index"), F.array(F.lit("x")).alias("koreanSummary")),
        F.struct(F.lit(99).alias("index"), F.array(F.lit("x")).alias("koreanSummary")),
    )
    sliced = pst.translation_slice(posts)
    lists = sliced.groupBy("digest_id").agg(
        F.array_sort(F.collect_list(first)).alias("a"), F.array_sort(F.collect_list(second)).alias("b")
    )
    content = F.concat(
        F.lit("```json\n"), F.to_json(F.struct(F.concat("a", "b", stray).alias("items"))), F.lit("\n```")
    )
    day = F.substring("digest_id", -2, 2)
    said = (
        F.when(day == "02", F.lit('{"answer": []}'))
        .when(day == "03", F.lit(" "))
        .otherwise(content)
    )
    body = F.to_json(F.struct(F.array(F.struct(F.struct(said.alias("content")).alias("message"))).alias("choices")))
    status = F.when(day == "04", 429).otherwise(200)
    return lists.select("digest_id", status.alias("status"), body.alias("body"))


KO_LIST_SQL = f"['핵심 ' || title, '둘', {quoted(KO_FILLERS[0])}]"
ANSWERED_SQL = "right(digest_id, 2) NOT IN ('02', '03', '04')"


@query(
    "n4_model_content",
    f"""WITH {CHOICE_SQL} SELECT DISTINCT digest_id, CASE right(digest_id, 2) WHEN '02' THEN '{{"answer": []}}'
  WHEN '03' THEN ' ' ELSE '```json' END AS content FROM shown""",
)
def _(spark, sf):
    _, posts = display(spark, sf)
    content = jsn.model_content(C("body"))
    first_line = F.split_part(content, F.lit("\n"), F.lit(1))
    return answers(posts).select("digest_id", first_line.alias("content"))


@query(
    "n5_strip_code_fence",
    f"""SELECT doc_id, {q.trim("text")} AS out FROM documents""",
)
def _(spark, sf):
    lang, text = C("lang"), C("text")
    fenced = (
        F.when(lang == "fr", F.concat(F.lit(" ```json\n"), text, F.lit("\n``` ")))
        .when(lang == "de", F.concat(F.lit("```"), text, F.lit("```")))
        .when(lang == "es", F.concat(F.lit("```json```"), text))
        .otherwise(text)
    )
    return v.texts(spark, sf, "documents").select("doc_id", jsn.strip_code_fence(fenced).alias("out"))


@query(
    "n6_parse_insights",
    f"""WITH {DISPLAY_SQL}
SELECT digest_id, rank - 1 AS index, {joined(KO_LIST_SQL)} AS korean FROM display
WHERE rank <= 10 AND {ANSWERED_SQL}""",
)
def _(spark, sf):
    _, posts = display(spark, sf)
    found = ins.parse_insights(answers(posts))
    return found.select(
        "digest_id", C("index").cast("bigint").alias("index"), glue("korean_summary").alias("korean")
    )


def insight_posts(posts):
    sliced = pst.translation_slice(posts)
    return ins.attach_insights(sliced, ins.parse_insights(answers(posts)))


@query(
    "j6_attach_insights",
    f"""WITH {DISPLAY_SQL}
SELECT digest_id, rank - 1 AS index, title,
  CASE WHEN {ANSWERED_SQL} THEN {joined(KO_LIST_SQL)} ELSE '' END AS korean
FROM display WHERE rank <= 10""",
)
def _(spark, sf):
    _, posts = display(spark, sf)
    return insight_posts(posts).select(
        "digest_id",
        C("index").cast("bigint").alias("index"),
        "title",
        glue("korean_summary").alias("korean"),
    )


@query(
    "a4_translated_posts",
    f"""WITH {DISPLAY_SQL}
SELECT digest_id, count(*) FILTER ({ANSWERED_SQL}) AS translated_posts,
  count(*) FILTER ({ANSWERED_SQL}) > 0 AS succeeded,
  CASE WHEN count(*) FILTER ({ANSWERED_SQL}) = 0 THEN {quoted(ERROR_NO_HANGUL)} END AS error
FROM display WHERE rank <= 10 GROUP BY digest_id""",
)
def _(spark, sf):
    _, posts = display(spark, sf)
    return sts.translated_posts(insight_posts(posts))


@query(
    "n9_diagnostics",
    f"""WITH {DISPLAY_SQL}, t AS (
  SELECT r.digest_id, (SELECT count(*) FROM display d WHERE d.digest_id = r.digest_id AND rank <= 10) AS n
  FROM runs r)
SELECT digest_id, n > 0 AS configured, n > 0 AS attempted, n > 0 AND {ANSWERED_SQL} AS succeeded,
  CASE WHEN n > 0 AND {ANSWERED_SQL} THEN n ELSE 0 END AS translated_posts,
  CASE WHEN n = 0 THEN 'AOAI_ENDPOINT/AOAI_DEPLOYMENT not set'
    WHEN right(digest_id, 2) = '04' THEN 'HTTP 429'
    WHEN right(digest_id, 2) = '03' THEN 'Empty content in AOAI response'
    WHEN right(digest_id, 2) = '02' THEN 'Missing ''items'' array in AOAI JSON content' END AS error
FROM t""",
)
def _(spark, sf):
    chosen, posts = display(spark, sf)
    return ins.diagnostics(chosen.runs, answers(posts), insight_posts(posts))


def _summary_answers(spark, sf):
    """Answers for single posts: proper, JSON text of lists, plain lines, doubly encoded, broken."""
    title, lang, n = C("text"), C("lang"), C("doc_id") % 5
    proper = F.to_json(F.struct(F.array(title, lang).alias("englishSummary"), F.array(lang).alias("KOREANSUMMARY")))
    listed = F.to_json(
        F.struct(F.to_json(F.array(title)).alias("englishSummary"), F.concat(lang, F.lit("\r\n \n "), lang).alias("koreanSummary"))
    )
    pascal = F.to_json(F.struct(F.array(title).alias("EnglishSummary"), lang.alias("KoreanSummary")))
    doubled = F.get_json_object(F.to_json(F.struct(F.to_json(F.struct(pascal.alias("x"))).alias("y"))), "$.y")
    quoted_text = F.regexp_extract(doubled, r'(?s)^\{"x":(.*)\}$', 1)
    content = (
        F.when(n == 0, proper)
        .when(n == 1, listed)
        .when(n == 2, pascal)
        .when(n == 3, quoted_text)
        .otherwise(F.concat(title, F.lit("{")))
    )
    return v.texts(spark, sf, "documents").select("doc_id", content.alias("content"))


@query(
    "n7_parse_summary_lenient",
    f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || {quoted(GLUE)} || lang
    WHEN 4 THEN {quoted(MISSING_EN)} ELSE text END AS english,
  CASE doc_id % 5 WHEN 1 THEN lang || {quoted(GLUE)} || lang WHEN 4 THEN {quoted(MISSING_KO)}
    ELSE lang END AS korean FROM documents""",
)
def _(spark, sf):
    parsed = _summary_answers(spark, sf).select(
        "doc_id", jsn.parse_summary_lenient(C("content")).alias("s")
    )
    return parsed.select(
        "doc_id",
        glue("s.english_summary").alias("english"),
        glue("s.korean_summary").alias("korean"),
    )


ROUND_SQL = "translate(text, '[]', '()')"


@query(
    "n8_first_string_array",
    f"""SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN {ROUND_SQL} || {quoted(GLUE)} || lang END AS lines
FROM documents""",
)
def _(spark, sf):
    """Answers with the list in plain text, deep in an object, or not at all."""
    title, n = F.translate("text", "[]", "()"), C("doc_id") % 3
    both = F.array(title, C("lang"))
    deep = F.struct(F.array(F.lit(None).cast("string")).alias("n"), both.alias("z"))
    nested = F.struct(
        F.array(F.lit(1), F.lit(2)).alias("numbers"),
        F.lit('said ["no"]').alias("note"),
        F.array(deep).alias("items"),
    )
    content = (
        F.when(n == 0, F.concat(F.lit("Sure: "), F.to_json(both)))
        .when(n == 1, F.to_json(nested))
        .otherwise(F.to_json(F.struct(title.alias("t"))))
    )
    return v.texts(spark, sf, "documents").select(
        "doc_id", glue(jsn.first_string_array(content)).alias("lines")
    )


@query(
    "n10_json_encode_arrays",
    f"SELECT doc_id, text || {quoted(GLUE)} || '한국어 ' || lang AS lines FROM documents",
)
def _(spark, sf):
    stored = jsn.bullet_text(F.array(C("text"), F.concat(F.lit("한국어 "), C("lang"))))
    rows = v.texts(spark, sf, "documents").select("doc_id", stored.alias("t"))
    return rows.select("doc_id", glue(F.from_json("t", "array<string>")).alias("lines"))


# --- pages -------------------------------------------------------------------------------


def finished(spark, sf):
    """Display posts with paragraph and insights, as the page shows them."""
    chosen, posts = display(spark, sf)
    informed = dig.with_insights(posts, ins.parse_insights(answers(posts)))
    return chosen, dig.with_paragraph(informed, v.linked_pages(spark, sf))


def _div(cls: str, *inner: str) -> str:
    return " || ".join([quoted(f'<div class="{cls}">'), *inner, quoted("</div>")])


def _li(lines: str) -> str:
    item = f"'<li>' || {q.encode('e')} || '</li>'"
    return f"array_to_string(list_transform({lines}, lambda e: {item}), '')"


FULL_TAIL_SQL = f"""{v.LINKED_SQL},
found AS (SELECT k, arg_min({txq._paragraph_sql()}, md5(html)) AS page_text FROM linked GROUP BY 1),
full_display AS (SELECT d.*, coalesce(f.page_text, '') AS page_text FROM display d LEFT JOIN found f ON lower(d.link) = f.k)"""
FULL_SQL = f"{DISPLAY_SQL}, {FULL_TAIL_SQL}"
PARAGRAPH_SQL = f"""CASE WHEN page_text <> '' THEN page_text
  WHEN {txq._sentence_sql('summary')} <> '' THEN {txq._sentence_sql('summary')} ELSE summary END"""
CARD_SQL = " || ".join(
    [
        _div(
            "post",
            _div(
                "post-title",
                f"'<span class=\"tag\">' || emoji || ' ' || {q.encode('source_name')} || '</span>'",
                q.encode("title"),
            ),
            _div("date", "'📅 '", "strftime(published + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M')"),
            f"CASE WHEN {PARAGRAPH_SQL} = '' THEN '' ELSE "
            + _div("label", quoted(LABELS["paragraph"]))
            + " || "
            + _div("paragraph", q.encode(PARAGRAPH_SQL))
            + " END",
            _div("label", quoted(LABELS["insights"])),
            "'<ul class=\"bullets\">'",
            f"CASE WHEN rank <= 10 AND {ANSWERED_SQL} THEN {_li(KO_LIST_SQL)} "
            f"ELSE {_li(q.listed(KO_CARD_FILLERS))} END",
            "'</ul>'",
            f"'<a class=\"link\" href=\"' || {q.encode('link')} || '\">{LABELS['read']}</a>'",
        )
    ]
)


@query("t34_post_card_html", f"WITH {FULL_SQL} SELECT digest_id, rank, {CARD_SQL} AS card FROM full_display")
def _(spark, sf):
    _, ready = finished(spark, sf)
    return ready.select(
        "digest_id", C("rank").cast("bigint").alias("rank"), rnd.post_card_html().alias("card")
    )


def _cells(*values: str) -> str:
    return "'<tr><td>' || " + " || '</td><td>' || ".join(values) + " || '</td></tr>'"


STATE_SQL = "CASE WHEN ok THEN 'OK' ELSE 'FAIL' END"
SUMMARY_ROW_SQL = _cells(
    q.encode("source_name"),
    "CASE WHEN items_new > 0 THEN items_new || '개' ELSE '없음' END",
    STATE_SQL,
)
DETAIL_ROW_SQL = _cells(
    q.encode("source_name"),
    STATE_SQL,
    "items_new",
    "items",
    "elapsed_ms || ' ms'",
    q.encode("coalesce(error, '')"),
)


def _label(name: str, *values: str) -> str:
    text = quoted(LABELS[name])
    for value in values:
        text = text.replace("%d", f"' || {value} || '", 1)
    return text


def _table(columns: list[str], rows: str) -> str:
    return "'<table><tr><th>' || " + " || '</th><th>' || ".join(columns) + f" || '</th></tr>' || {rows} || '</table>'"


HEADER_SQL = _div(
    "header",
    quoted(f"<h1>{LABELS['heading']}</h1>"),
    _div("meta", f"CASE WHEN n > 0 THEN {_label('count_new', 'n', 'h')} ELSE {_label('count_none', 'h')} END"),
    _div("schedule", q.encode(quoted("매일 07:00, 19:00 (KST)에 새로운 게시글을 확인합니다."))),
)
CONTENT_SQL = _div(
    "content",
    _div(
        "status",
        _div("label", _label("status_heading", "h")),
        _table(["'Source'", _label("status_columns", "h"), quoted(LABELS["status_state"])], "srows"),
    ),
    f"CASE WHEN n > 0 THEN '' ELSE {_div('notice', _label('no_new', 'h'))} END",
    "CASE WHEN total > 0 THEN '' ELSE "
    + _div("post", _div("post-title", quoted(LABELS["no_posts"])), _div("hint", quoted(LABELS["no_posts_hint"])))
    + " END",
    "cards",
    _div(
        "detail",
        _div("label", quoted(LABELS["detail_heading"])),
        _table(
            ["'Source'", "'Status'", _label("status_columns", "h"), _label("detail_days", "days"), "'Elapsed'", "'Error'"],
            "drows",
        ),
    ),
)
PAGE_TAIL_SQL = f"""
cards AS (
  SELECT digest_id, string_agg({CARD_SQL}, '' ORDER BY rank) AS cards, count(*) AS total
  FROM full_display GROUP BY 1),
rows_ AS (
  SELECT digest_id, string_agg({SUMMARY_ROW_SQL}, '' ORDER BY upper(source_name), feed_pos) AS srows,
    string_agg({DETAIL_ROW_SQL}, '' ORDER BY feed_pos) AS drows FROM statuses GROUP BY 1),
parts AS (
  SELECT r.digest_id, r.feed_group, coalesce(c.cards, '') AS cards, coalesce(c.total, 0) AS total,
    coalesce(c.total, 0) AS n, r.new_window_hours AS h, r.days_since AS days,
    coalesce(s.srows, '') AS srows, coalesce(s.drows, '') AS drows
  FROM runs r LEFT JOIN cards c USING (digest_id) LEFT JOIN rows_ s USING (digest_id)),
pages_ AS (
  SELECT digest_id, feed_group,
    CASE WHEN n > 0 THEN replace({quoted(SUBJECT_NEW)}, '%d', n::VARCHAR) ELSE {quoted(SUBJECT_NONE)} END
      AS subject,
    '<!DOCTYPE html><html><head><meta charset="utf-8"></head><body>' || {_div(
      "container", HEADER_SQL, CONTENT_SQL, quoted('<div class="footer"></div>'))}
      || '</body></html>' AS html FROM parts)"""
PAGE_SQL = f"WITH {FULL_SQL}, {v.FEEDS_SQL},\n{STATES_SQL},{PAGE_TAIL_SQL}"


def digest_pages(spark, sf):
    chosen, ready = finished(spark, sf)
    return dig.render(chosen.runs, ready, tbq.run_statuses(spark, sf, chosen.runs))


@query("t35_digest_html", f"{PAGE_SQL} SELECT digest_id, subject, html FROM pages_")
def _(spark, sf):
    return digest_pages(spark, sf).select("digest_id", "subject", "html")


@query("s8_write_digests", f"{PAGE_SQL} SELECT feed_group, digest_id, subject, md5(html) AS html_md5 FROM pages_")
def _(spark, sf):
    """Pages written as JSON and read back."""
    path = shared_dir(spark, "digests")
    write_digests(digest_pages(spark, sf), path)
    return _written(spark, path)


def _written(spark, path):
    return read_digests(spark, path).select("feed_group", "digest_id", "subject", F.md5("html").alias("html_md5"))


@query("s8_write_digests_in_turn", SQL["s8_write_digests"])
def _(spark, sf):
    """One feed group after the other, runs at noon after all others, and one group again."""
    path = shared_dir(spark, "digests")
    pages = settle(digest_pages(spark, sf), "pages")
    noon = F.hour("as_of") == 12
    for part in (~noon & (C("feed_group") == "security"), ~noon & (C("feed_group") != "security"), noon, C("feed_group") == "security"):
        write_digests(pages.filter(part), path)
    return _written(spark, path)


@query(
    "a10_assemble_digest",
    f"""{PAGE_SQL}, p AS (
  SELECT digest_id, string_agg(rank || ':' || link, ' ' ORDER BY rank) AS posts FROM display GROUP BY 1),
f AS (
  SELECT digest_id, string_agg(feed_id || '=' || items || '/' || items_new, ' ' ORDER BY feed_pos) AS feeds
  FROM statuses GROUP BY 1)
SELECT g.digest_id, g.feed_group, g.subject, p.posts, f.feeds
FROM pages_ g LEFT JOIN p USING (digest_id) LEFT JOIN f USING (digest_id)""",
)
def _(spark, sf):
    chosen, posts = display(spark, sf)
    recent = posts.withColumn("is_recent", is_new(C("as_of"), C("new_window_hours")))
    built = rnd.assemble_digest(recent, tbq.run_statuses(spark, sf), chosen.runs)
    listed = F.transform("posts", lambda p: F.concat_ws(":", p["rank"].cast("string"), p["link"]))
    feeds = F.transform(
        "feeds",
        lambda s: F.concat(
            s["feed_id"], F.lit("="), s["items"].cast("string"), F.lit("/"), s["items_new"].cast("string")
        ),
    )
    return built.select(
        "digest_id",
        "feed_group",
        "subject",
        F.array_join(listed, " ").alias("posts"),
        F.array_join(feeds, " ").alias("feeds"),
    )


def _points(cls: str, label: str, lines: str) -> str:
    item = q.encode(q.clean_point("e"))
    rows = f"array_to_string(list_transform({lines}, lambda e: '<div>• ' || {item} || '</div>'), '')"
    return _div(cls, _div("label", quoted(LABELS[label])), rows)


def _encoded_lines(lines: str) -> str:
    item = q.encode("e")
    return f"array_to_string(list_transform({lines}, lambda e: '<div>' || {item} || '</div>'), '')"


LEGACY_SQL = _div(
    "post",
    _div("post-title", f"'<span class=\"tag\">' || {q.encode('source_name')} || '</span>'", q.encode("title")),
    "'<div class=\"post-meta\">' || CASE WHEN published IS NULL THEN '' "
    "ELSE '📅 ' || strftime(published, '%Y년 %m월 %d일') END || '</div>'",
    "CASE WHEN len(excerpt) > 0 THEN "
    + _div("excerpt", _encoded_lines("list_concat(excerpt, ['', '', ''])[1:3]"))
    + " ELSE "
    + _div("post-summary", q.encode("summary_text"))
    + " END",
    _points("insights-en", "legacy_en", "en"),
    _points("insights-ko", "legacy_ko", "ko"),
    f"'<a class=\"post-link\" href=\"' || {q.encode(f'coalesce(link, {quoted("")})')} || '\">{LABELS['read']}</a>'",
)


@query(
    "t37_legacy_card",
    f"""WITH {txq.MAIL_SQL}, both_ AS (SELECT *, {txq.EN_SQL} AS en, {txq.KO_SQL} AS ko FROM lined)
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN {_div("placeholder", quoted(f"&#{ord(DEFAULT_EMOJI) - 0x10000 >> 10 | 0xD800};&#{ord(DEFAULT_EMOJI) - 0x10000 & 0x3FF | 0xDC00}; "),
  q.encode("source_name"), quoted(": " + LABELS["legacy_none"]))} ELSE {LEGACY_SQL} END AS card FROM both_""",
)
def _(spark, sf):
    lines = txq.mail_lines(spark, sf)
    title = F.when(C("doc_id") % 9 == 0, PLACEHOLDER_TITLES[0]).otherwise(C("title"))
    return lines.withColumn("title", title).select("doc_id", rnd.legacy_card().alias("card"))


MAIL_PAGE_SQL = f"""WITH {DISPLAY_SQL}, {txq.ARTICLE_SQL},
mails AS (
  SELECT digest_id, rank, link, title, summary, source_name, published, bullets AS english,
    CASE WHEN rank % 2 = 0 THEN {KO_LIST_SQL} END AS korean FROM display), {txq.LINES_SQL},
both_ AS (SELECT *, {txq.EN_SQL} AS en, {txq.KO_SQL} AS ko FROM lined),
mail_cards AS (
  SELECT digest_id, string_agg({LEGACY_SQL}, '' ORDER BY rank) AS cards, count(*) AS n
  FROM both_ GROUP BY 1)
SELECT r.digest_id, CASE WHEN coalesce(n, 0) > 0 THEN replace({quoted(SUBJECT_NEW)}, '%d', n::VARCHAR)
    ELSE {quoted(SUBJECT_NONE)} END AS subject,
  '<!DOCTYPE html><html><head><meta charset="utf-8"></head><body>' || {_div("container",
    _div("header", quoted(f"<h1>{LABELS['heading']}</h1>"), _div("count",
      f"CASE WHEN coalesce(n, 0) > 0 THEN {_label('mail_new', 'n')} ELSE {quoted(LABELS['legacy_none'])} END")),
    _div("content",
      "CASE WHEN coalesce(n, 0) = 0 THEN " + _div("post", _div("post-title", quoted(LABELS["mail_error"])),
        _div("post-summary", quoted(LABELS["mail_error_hint"]))) + " ELSE '' END",
      "coalesce(cards, '')"),
    _div("footer", quoted("매일")))} || '</body></html>' AS html
FROM runs r LEFT JOIN mail_cards c USING (digest_id)"""


@query("t37_mail_html", MAIL_PAGE_SQL)
def _(spark, sf):
    """Mails in the older layout from the display posts of each run."""
    chosen, posts = display(spark, sf)
    korean = F.array(F.concat(F.lit("핵심 "), C("title")), F.lit("둘"), F.lit(KO_FILLERS[0]))
    given = posts.withColumn("korean_summary", F.when(C("rank") % 2 == 0, korean))
    asked = chosen.runs.select("digest_id", F.lit("매일").alias("schedule_text"))
    return mail.mail_pages(
        asked,
        given.filter("is_new_post"),
        given.filter("NOT is_new_post"),
        txq.variants(spark, sf),
    )


# --- flagship ----------------------------------------------------------------------------

# Items as the payloads hold them; the second item of an RSS payload has no link and only counts.
ITEMS_SQL = f"""
items AS (
  SELECT p.item_pos, f.feed_id, f.feed_pos, f.feed_group, {q.trim("p.title")} AS title, p.link,
    {tbq.CLEAN_SQL.replace("summary", "p.summary")} AS summary, p.published,
    CASE WHEN coalesce(trim(f.source_name), '') = '' THEN 'Unknown' ELSE f.source_name END AS source_name,
    coalesce(f.emoji, {quoted(DEFAULT_EMOJI)}) AS emoji
  FROM posts p JOIN feeds f ON p.feed_id = f.feed_id WHERE p.lang <> 'de' AND trim(f.url) <> ''
  UNION ALL
  SELECT -1 - p.item_pos, f.feed_id, f.feed_pos, f.feed_group, 'No title', '', '', p.published, 'x', ''
  FROM posts p JOIN feeds f ON p.feed_id = f.feed_id
  WHERE p.lang <> 'de' AND trim(f.url) <> '' AND p.item_pos % 2 = 0),
outcomes AS (
  SELECT feed_id, max_by(CASE WHEN lang = 'de' THEN 'HTTP 503' ELSE '' END, item_pos) AS error,
    max_by(n_chars, item_pos) AS elapsed_ms FROM posts GROUP BY 1),
seen AS (
  SELECT r.digest_id, p.feed_id, p.published >= r.as_of - INTERVAL 1 HOUR * {v.HOURS_SQL} AS is_new
  FROM runs r JOIN items p ON r.feed_group = p.feed_group
    AND p.published >= r.as_of - INTERVAL 1 DAY * r.days_since AND p.published <= r.as_of),
counts AS (
  SELECT digest_id, feed_id, count(*) AS items, count(*) FILTER (is_new) AS items_new FROM seen GROUP BY ALL),
statuses AS (
  SELECT r.digest_id, f.feed_id, f.feed_pos, coalesce(f.source_name, 'Unknown') AS source_name,
    o.error = '' AS ok, o.elapsed_ms, CASE WHEN o.error = '' THEN coalesce(c.items, 0) ELSE 0 END AS items,
    CASE WHEN o.error = '' THEN coalesce(c.items_new, 0) ELSE 0 END AS items_new, nullif(o.error, '') AS error
  FROM runs r JOIN feeds f USING (feed_group) JOIN outcomes o USING (feed_id)
    LEFT JOIN counts c USING (digest_id, feed_id) WHERE trim(f.url) <> '')"""


def _of_items(sql: str) -> str:
    """The same SQL over items in place of posts, blank links left out where links count."""
    return sql.replace("posts p ", "items p ").replace("JOIN posts p", "JOIN items p")


_CHOSEN_SQL = _of_items(tbq.CHOICE_TAIL_SQL).replace(
    "AND p.published <= r.as_of\n  QUALIFY", "AND p.published <= r.as_of AND p.link <> ''\n  QUALIFY"
)
_NEW_SQL = "SELECT * FROM display WHERE is_new_post"
DIGEST_SQL = f"""WITH {v.PROCESSED_SQL}, {v.RUNS_SQL}, {v.FEEDS_SQL}, {ITEMS_SQL},{_CHOSEN_SQL},
{_of_items(_display_sql("p.emoji"))}, {FULL_TAIL_SQL},{PAGE_TAIL_SQL},
feeds_ AS (
  SELECT digest_id, string_agg(concat_ws('|', feed_id, source_name, ok, items, items_new, elapsed_ms,
    coalesce(error, '')), ' ' ORDER BY feed_pos, feed_id) AS statuses FROM statuses GROUP BY 1),
kept_ AS (
  SELECT digest_id, string_agg(concat_ws('|', {v.PK_SQL}, {v.RK_SQL}, md5(title), md5(summary), link,
    strftime(published, {v.ISO}), strftime(as_of, {v.ISO}), md5({joined("bullets")}),
    CASE WHEN rank <= 10 AND {ANSWERED_SQL} THEN md5({joined(KO_LIST_SQL)}) ELSE md5('') END), ' ' ORDER BY rank) AS state
  FROM display WHERE is_new_post GROUP BY 1)
SELECT r.digest_id, r.feed_group, g.subject, g.html, coalesce(f.statuses, '') AS statuses,
  coalesce(k.state, '') AS state,
  (SELECT count(DISTINCT upper(link)) FROM items x WHERE x.feed_group = r.feed_group AND link <> ''
    AND x.published >= r.as_of - INTERVAL 1 DAY * r.days_since AND x.published <= r.as_of) AS all_items,
  (SELECT count(*) FROM new_posts x WHERE x.digest_id = r.digest_id) AS new_posts,
  (SELECT count(*) FROM shown x WHERE x.digest_id = r.digest_id) AS display_posts,
  (SELECT count(*) FROM shown x WHERE x.digest_id = r.digest_id) AS recent_posts,
  (SELECT count(*) FROM shown x WHERE x.digest_id = r.digest_id) > 0 AND {ANSWERED_SQL.replace("digest_id", "r.digest_id")} AS succeeded
FROM runs r JOIN pages_ g USING (digest_id) LEFT JOIN feeds_ f USING (digest_id) LEFT JOIN kept_ k USING (digest_id)"""


@query("digest_pages", DIGEST_SQL)
def _(spark, sf):
    """Whole digests from payloads: subject, page, feed states, counts and the rows for the state table."""
    payloads, feeds = tbq.feed_payloads(spark, sf), v.feeds(spark, sf)
    items = settle(dig.ingest(payloads, feeds), "items")
    runs, keys, pages = v.runs(spark, sf), v.state_keys(spark, sf), v.linked_pages(spark, sf)
    chosen = dig.choose_posts(runs, items, keys).settled()
    posts = settle(dig.with_text(chosen.shown, items), "display")
    said = settle(answers(posts), "answers")
    built = dig.finish_digests(chosen, posts, feeds, payloads, items, pages, said)

    fields = ["feed_id", "source_name", "ok", "items", "items_new", "elapsed_ms"]
    text = F.concat_ws("|", *[C(c).cast("string") for c in fields], F.coalesce("error", F.lit("")))
    states = _listed(built.statuses, "statuses", "feed_pos", "feed_id", text)
    new = built.posts.filter("is_new_post").select("digest_id", "link", "source_name", "rank")
    rows = dig.new_state_rows(built.posts).drop("source_name")
    keyed = pst.with_keys(new).select("digest_id", "rank", "pk", "rk", F.col("link").alias("_link"))
    stored = rows.join(keyed, ["pk", "rk"]).filter((C("link") == C("_link")) & (C("digest_id").isNotNull()))
    line = F.concat_ws(
        "|", "pk", "rk", F.md5("title"), F.md5("summary"), "link", "publish_date", format_iso(C("processed_date")),
        *[F.md5(glue(F.from_json(c, "array<string>"))) for c in ("english_summary", "korean_summary")],
    )
    as_of = chosen.runs.select("digest_id", C("as_of").alias("_as_of"))
    kept = _listed(stored.join(as_of, "digest_id").filter("processed_date = _as_of"), "state", "rank", "rk", line)
    stats = built.stats.select(
        "digest_id", "all_items", "new_posts", "display_posts", "recent_posts", "succeeded"
    )
    out = built.pages.drop("as_of").join(stats, "digest_id").join(states, "digest_id", "left").join(kept, "digest_id", "left")
    return out.na.fill("", ["statuses", "state"])


def _listed(rows, name, *order_then_text):
    *order, text = order_then_text
    listed = F.array_sort(F.collect_list(F.struct(*order, text.alias("t"))))
    return rows.groupBy("digest_id").agg(F.array_join(listed["t"], " ").alias(name))



@query(
    "digest_report",
    f"""WITH {CHOICE_SQL}
SELECT r.digest_id, r.feed_group,
  {tbq.ALL_ITEMS_SQL} AS all_items,
  (SELECT count(*) FROM new_posts x WHERE x.digest_id = r.digest_id) AS new_posts,
  (SELECT count(*) FROM shown x WHERE x.digest_id = r.digest_id) AS display_posts,
  CASE WHEN (SELECT count(*) FROM shown x WHERE x.digest_id = r.digest_id) > 0
    THEN replace({quoted(SUBJECT_NEW)}, '%d', (SELECT count(*) FROM shown x
      WHERE x.digest_id = r.digest_id)::VARCHAR) ELSE {quoted(SUBJECT_NONE)} END AS subject
FROM runs r""",
)
def _(spark, sf):
    """Counts and subject of each run."""
    c = tbq.choice(spark, sf)
    counts = sts.digest_counts(c.links, c.shown, c.runs)
    return counts.join(c.runs.select("digest_id", "feed_group"), "digest_id").select(
        "digest_id",
        "feed_group",
        "all_items",
        "new_posts",
        "display_posts",
        rnd.subject_line(C("recent_posts")).alias("subject"),
    )

