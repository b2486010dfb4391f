"""Feed registry, payload parsing and feed items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import schemas
from feedloom.functions.constants import NO_TITLE, NOT_XML, NOT_XML_HTML, UNKNOWN_SOURCE
from feedloom.functions.dates import ago, parse_pubdate, published_or_updated
from feedloom.functions.html import strip_tags_lazy
from feedloom.functions.text import is_blank, no_strings, trim_u

# Registry lists and the feed group each one serves.
REGISTRY_LISTS = {"securityFeeds": "security", "azureCloudFeeds": "azureCloud"}


def feed_registry(config: DataFrame) -> DataFrame:
    """Active feeds of the registry; `config` holds the two feed lists as arrays."""
    parts = [
        config.select(F.lit(group).alias("feed_group"), F.posexplode(name).alias("feed_pos", "f"))
        for name, group in REGISTRY_LISTS.items()
    ]
    rows = parts[0].unionByName(parts[1])
    return rows.filter("f.active").select(
        "feed_group",
        "feed_pos",
        F.col("f.sourceName").alias("source_name"),
        "f.url",
        "f.emoji",
        "f.category",
        "f.active",
    )


def read_feed_config(spark, path: str) -> DataFrame:
    return spark.read.schema(schemas.FEED_CONFIG).json(path, multiLine=True)


def parse_feed_config(texts: DataFrame, body: str = "body") -> DataFrame:
    """Registry lists from JSON text rows."""
    return texts.select(F.from_json(body, schemas.FEED_CONFIG).alias("c")).select("c.*")


def classify_payload(body: Column) -> Column:
    """`html`, `xml` or `other`, from the head of the payload; html wins."""
    text = trim_u(F.lower(F.coalesce(body, F.lit(""))))
    html = text.startswith("<!doctype html") | text.startswith("<html")
    xml = (
        text.startswith("<?xml")
        | text.startswith("<rss")
        | F.contains(F.substring(text, 1, 200), F.lit("<rss"))
    )
    return F.when(html, "html").when(xml, "xml").otherwise("other")


def entry_count(body: Column) -> Column:
    """How often `<item>` or `<entry>` occurs, in this exact spelling."""
    return F.regexp_count(F.coalesce(body, F.lit("")), F.lit("<item>|<entry>"))


# Prefixed elements keep their prefix, so `media:title` never passes for the title of an item.
_XML_OPTIONS = {"mode": "PERMISSIVE", "attributePrefix": "_"}


def _ok(payloads: DataFrame) -> DataFrame:
    return payloads.filter("error IS NULL AND body IS NOT NULL AND http_status BETWEEN 200 AND 299")


def _rss_item(i: Column) -> Column:
    return F.struct(
        i["title"].alias("title"),
        _given(i["link"]).alias("links"),
        i["description"].alias("summary"),
        i["pubDate"].alias("published_raw"),
        F.coalesce(i["a10:updated"], i["atom:updated"]).alias("updated_raw"),
        _given(i["category"]).alias("categories"),
    )


def _given(values: Column) -> Column:
    return F.filter(F.coalesce(values, no_strings()), lambda x: ~is_blank(x))


def _atom_item(i: Column) -> Column:
    return F.struct(
        i["title"]["_VALUE"].alias("title"),
        _given(i["link"]["_href"]).alias("links"),
        i["summary"]["_VALUE"].alias("summary"),
        i["published"].alias("published_raw"),
        i["updated"].alias("updated_raw"),
        _given(i["category"]["_term"]).alias("categories"),
    )


def _exploded(payloads: DataFrame, schema: str, items: Callable[[], Column]) -> DataFrame:
    # The time of arrival stays with the items: a stream drops late repeats by it.
    keep = [c for c in ("feed_id", "fetched_at") if c in payloads.columns]
    parsed = _ok(payloads).select(*keep, F.from_xml("body", F.lit(schema), _XML_OPTIONS).alias("x"))
    rows = parsed.select(*keep, F.posexplode(items()).alias("item_pos", "i"))
    return rows.select(*keep, "item_pos", "i.*")


def _rss_items() -> Column:
    return F.transform("x.channel.item", _rss_item)


def _atom_items() -> Column:
    return F.transform("x.entry", _atom_item)


def parse_rss(payloads: DataFrame) -> DataFrame:
    """Items of RSS payloads; a payload that is not RSS yields none."""
    return _exploded(payloads, schemas.RSS, _rss_items)


def parse_atom(payloads: DataFrame) -> DataFrame:
    """Entries of Atom payloads; the link is the `href` attribute."""
    return _exploded(payloads, schemas.ATOM, _atom_items)


def parse_feeds(payloads: DataFrame) -> DataFrame:
    """Items of RSS and Atom payloads; each payload is parsed once."""
    return _exploded(
        payloads, schemas.FEED_XML, lambda: F.coalesce(_rss_items(), _atom_items())
    )


def _outcome(x: Column) -> Column:
    """Why a payload, parsed as `x`, gave no feed, else null."""
    status, given = F.col("http_status"), F.col("error")
    feed = F.coalesce(
        x["channel"].isNotNull() | x["entry"].isNotNull() | x["title"].isNotNull() | x["id"].isNotNull(),
        F.lit(False),
    )
    return (
        F.when(given.isNotNull(), given)
        .when(~status.between(200, 299), F.concat(F.lit("HTTP "), status.cast("string")))
        .when(classify_payload(F.col("body")) == "html", F.lit(NOT_XML_HTML))
        .when(~feed, F.lit(NOT_XML))
    )


def _parsed(payloads: DataFrame) -> DataFrame:
    x = F.from_xml("body", F.lit(schemas.FEED_XML), _XML_OPTIONS)
    return payloads.withColumn("x", F.when(F.col("body").isNotNull(), x))


def payload_outcomes(payloads: DataFrame) -> DataFrame:
    """Why a payload gave no feed, else a null error: not fetched, refused, or no feed at all.

    An Atom body without an XML declaration is a feed here, as it parses.
    """
    arrival = [c for c in ("fetched_at",) if c in payloads.columns]
    return _parsed(payloads).select("feed_id", *arrival, "elapsed_ms", _outcome(F.col("x")).alias("error"))


def items_or_rejects(payloads: DataFrame) -> DataFrame:
    """Clean items, and a row for each payload without any, each payload parsed once.

    `kind` is `item`, or `reject` with a `reason`: that of the payload, none of whose items then count, `no items`, or an
    item's `no readable date`.
    """
    keep = [c for c in ("feed_id", "fetched_at") if c in payloads.columns]
    found = _parsed(payloads).select(
        *keep,
        _outcome(F.col("x")).alias("error"),
        F.coalesce(_rss_items(), _atom_items()).alias("items"),
    )
    # An error keeps its payload as one row without an item.
    given = found.withColumn("items", F.when(F.col("error").isNull(), F.col("items")))
    rows = given.select(*keep, "error", F.posexplode_outer("items").alias("item_pos", "i"))
    clean = clean_items(rows.select(*keep, "error", "item_pos", "i.*"), "error")
    none = F.col("item_pos").isNull()
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(none, F.lit(NO_ITEMS))
        .when(F.col("published").isNull(), F.lit(NO_DATE))
    )
    shown = [F.when(none, F.lit(None)).otherwise(F.col(c)).alias(c) for c in ("title", "link", "summary")]
    return clean.withColumn("reason", reason).select(
        *keep, "item_pos", *shown, "published", "categories", "reason",
        F.when(F.col("reason").isNull(), "item").otherwise("reject").alias("kind"),
    )


def latest_outcomes(payloads: DataFrame) -> DataFrame:
    """The outcome of the last payload of each feed; without a time of arrival there is one per feed."""
    found = payload_outcomes(payloads)
    if "fetched_at" not in found.columns:
        return found
    last = F.max(F.struct("fetched_at", "elapsed_ms", "error")).alias("o")
    return found.groupBy("feed_id").agg(last).select("feed_id", "o.elapsed_ms", "o.error")


def first_link(links: Column) -> Column:
    return F.coalesce(F.get(links, F.lit(0)), F.lit(""))


def title_default(title: Column) -> Column:
    return F.coalesce(title, F.lit(NO_TITLE))


def source_default(source: Column) -> Column:
    """Source name of a post: `Unknown` when blank."""
    return F.when(is_blank(source), F.lit(UNKNOWN_SOURCE)).otherwise(source)


def status_source_default(source: Column) -> Column:
    """Source name of a feed status: `Unknown` only when missing."""
    return F.coalesce(source, F.lit(UNKNOWN_SOURCE))


#: Reasons of rejects that no payload error names.
NO_ITEMS, NO_DATE = "no items", "no readable date"


def clean_items(items: DataFrame, *more: str) -> DataFrame:
    """Items with one link, a title, clean text and a publish time, and `more` of their columns."""
    published = published_or_updated(
        parse_pubdate(F.col("published_raw")), parse_pubdate(F.col("updated_raw"))
    )
    arrival = [c for c in ("fetched_at",) if c in items.columns]
    return items.select(
        "feed_id",
        "item_pos",
        *arrival,
        *more,
        title_default(F.col("title")).alias("title"),
        first_link(F.col("links")).alias("link"),
        strip_tags_lazy(F.col("summary")).alias("summary"),
        published.alias("published"),
        "categories",
    )


def undated_items(items: DataFrame) -> DataFrame:
    """Clean items that no window can hold, as their date was missing or unreadable."""
    return items.filter("published IS NULL").withColumn("reason", F.lit(NO_DATE))


def items_to_feeds(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """Items with source name, emoji, group and position of their feed.

    No broadcast hint: Spark broadcasts the registry only while it is below the size limit.
    """
    names = feeds.select(
        "feed_id",
        "feed_group",
        "feed_pos",
        source_default(F.col("source_name")).alias("source_name"),
        "emoji",
    )
    return items.join(names, "feed_id")


def sample_items(runs: DataFrame) -> DataFrame:
    """Three built-in items for pipeline checks, dated before each run's `as_of`."""
    rows = [
        F.struct(
            F.lit(pos).alias("item_pos"),
            F.lit(title).alias("title"),
            F.lit(link).alias("link"),
            F.lit(summary).alias("summary"),
            F.lit(hours).alias("hours"),
            F.array(*[F.lit(c) for c in categories]).alias("categories"),
        )
        for pos, (title, link, summary, hours, categories) in enumerate(SAMPLE_ITEMS)
    ]
    exploded = runs.select("digest_id", "as_of", F.explode(F.array(*rows)).alias("s"))
    return exploded.select(
        "digest_id",
        "s.item_pos",
        "s.title",
        "s.link",
        "s.summary",
        ago(F.col("as_of"), hours=F.col("s.hours")).alias("published"),
        "s.categories",
    )


# The built-in items as title, link, summary, hours before now, categories.
SAMPLE_ITEMS = [
    (
        "[테스트] Azure Security 주요 업데이트 - 제로 트러스트 아키텍처",
        "https://www.microsoft.com/security/blog/test-1",
        "Microsoft는 제로 트러스트 보안 모델의 최신 업데이트를 발표했습니다. 이번 업데이트는 ID 기반 접근 제어, 최소 권한 원칙, 그리고 지속적인 검증을 강화합니다.",
        2,
        ["Security", "Zero Trust", "Azure"],
    ),
    (
        "[테스트] Microsoft Defender 위협 인텔리전스 리포트 2024",
        "https://www.microsoft.com/security/blog/test-2",
        "2024년 상반기 사이버 위협 동향 분석 리포트가 공개되었습니다. 랜섬웨어 공격이 35% 증가했으며, AI를 활용한 피싱 공격이 새로운 트렌드로 부상했습니다.",
        5,
        ["Threat Intelligence", "Defender", "Report"],
    ),
    (
        "[테스트] Azure Sentinel SOAR 기능 강화 발표",
        "https://www.microsoft.com/security/blog/test-3",
        "Azure Sentinel의 보안 오케스트레이션 자동화 응답(SOAR) 기능이 대폭 개선되었습니다. 새로운 플레이북 템플릿과 커넥터가 추가되어 위협 대응 자동화가 더욱 강력해졌습니다.",
        8,
        ["Sentinel", "SOAR", "Automation"],
    ),
]
