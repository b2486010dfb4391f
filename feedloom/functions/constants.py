"""Texts, lists and patterns that results depend on."""

# Whitespace as the digest rules understand it (Unicode White_Space).
WS = (
    r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS_CHARS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# Request defaults and caps.
DEFAULT_DAYS_SINCE = 30
DEFAULT_MAX_ITEMS = 12
MAX_MAX_ITEMS = 30
DEFAULT_WINDOW_HOURS = 24
MAX_WINDOW_HOURS = 168
DEFAULT_SUMMARY_POINTS = 3
DEFAULT_SCHEDULE_TEXT = "매일 07:00, 19:00 (KST)에 새로운 게시글을 확인합니다."

# Default names.
UNKNOWN_SOURCE = "Unknown"
NO_TITLE = "No title"
DEFAULT_EMOJI = "📰"

# Bullet lines.
EN_FILLERS = [
    "See the original post for details.",
    "Open the article link for more context.",
    "More information is available in the full post.",
]
KO_FILLERS = [
    "자세한 내용은 원문을 참고하세요.",
    "추가 정보는 원문에 있습니다.",
    "원문 링크에서 전체 내용을 확인하세요.",
]
KO_CARD_FILLERS = [
    "핵심 인사이트를 생성하려면 AOAI 설정이 필요합니다.",
    "현재는 영어 요약만 제공됩니다.",
    "원문 링크에서 전체 내용을 확인하세요.",
]
BLANK_SUMMARY_BULLETS = [
    "Summary is not available in the RSS feed.",
    "Open the article link for full details.",
    "This digest was generated without full-page scraping.",
]
SAFE_LINES = [
    "See the linked article for additional context.",
    "Refer to the source article for full details.",
    "Check the original post for more information.",
]
KO_UNAVAILABLE = [
    "한국어 요약을 사용할 수 없습니다.",
    "AOAI 번역이 구성되지 않았거나 실패했습니다.",
    "원문을 확인하세요",
]
LEGACY_PREFIX = "(번역 미구성)"

# Summaries for empty or unusable model answers.
EMPTY_EN, EMPTY_KO = "[No content available]", "[사용 가능한 콘텐츠 없음]"
MISSING_EN, MISSING_KO = "Summary not available", "요약을 사용할 수 없습니다"

# Rows that only say a feed had nothing new.
PLACEHOLDER_TITLES = [
    "No new posts in last 24 hours",
    "No new posts in last 7 days",
    "No new posts in last 30 days",
]
PLACEHOLDER_SUMMARY = "No new posts"
PLACEHOLDER_BULLET = "No new posts in the last 24 hours."

# Page lines to drop.
BOILERPLATE = [
    "Content types",
    "Best practices",
    "Products and services",
    "Microsoft Defender",
    "Microsoft Security Copilot",
    "Microsoft Sentinel",
    "Topics",
    "Skip to content",
    "Search",
    "All Microsoft",
    "| Microsoft Security Blog",
]

# The sentence that must not be shown, and its close variants.
UNWANTED_PHRASE = "point solutions can only go so far"
UNWANTED_PAIR = ("but point solutions", "go so far")
BANNED_TOPIC = "point solution"
BANNED_LIMITS = ["holding you back", "hold you back", "go so far"]

# Bullet characters.
BULLETS = "•‣◦⁃∙"
POINT_CHARS = BULLETS + "·" + "â€¢"

# Emoji of a source, as the state reader and the mail writer know them.
EMOJI_RECENT = {
    "Microsoft Security Blog": "🛡️",
    "Azure Security Blog": "🔐",
    "Microsoft Entra Blog": "🔑",
    "Sentinel Blog": "👁️",
    "Defender Blog": "🛡️",
    "Azure DevOps Blog": "🔧",
    "Azure Architecture Blog": "📊",
    "Azure Infrastructure Blog": "🏗️",
    "Azure Governance and Management Blog": "🏢",
    "Azure DevOps Community": "🔨",
    "Azure Integration Services Blog": "⚡",
}
EMOJI_MAIL = {
    "Microsoft Security Blog": "🛡️",
    "Microsoft Sentinel Blog": "🔐",
    "Zero Trust Blog": "🌐",
    "Threat Intelligence": "🎯",
    "Cybersecurity Insights": "💡",
    "Azure Blog": "☁️",
    "Azure DevOps Blog": "🔧",
    "Fabric Blog": "📊",
    "Architecture Center": "🏗️",
    "Azure Infrastructure": "🏢",
    "Microsoft 365 Dev": "🔨",
    "Power Platform": "⚡",
    "Azure Security Blog": "🔒",
    "MS Security - Threat Intelligence": "🔍",
    "TC - Microsoft Defender": "🛡️",
    "TC - Microsoft Sentinel": "👁️",
}

# Subject lines.
SUBJECT_PREFIX = "[Microsoft Azure 업데이트] "
SUBJECT_NEW = SUBJECT_PREFIX + "새 게시글 %d개"
SUBJECT_NONE = SUBJECT_PREFIX + "최근 게시글 요약 (신규 없음)"

# Limits in UTF-16 units.
PAGE_SLICE, PAGE_TEXT, PAGE_LINES = 60000, 8000, 200

# Error texts of the model exchange.
ERROR_NOT_CONFIGURED = "AOAI_ENDPOINT/AOAI_DEPLOYMENT not set"
ERROR_EMPTY = "Empty content in AOAI response"
ERROR_NO_ITEMS = "Missing 'items' array in AOAI JSON content"
ERROR_NOT_JSON = "JsonException"
ERROR_NO_HANGUL = "AOAI call succeeded but produced no Hangul output"

# Reasons why a payload is no feed.
NOT_XML_HTML, NOT_XML, NO_PAYLOAD = "HTML instead of XML", "Not XML format", "No payload"

# Labels of the digest page.
LABELS = {
    "heading": "☁️ Microsoft Azure 업데이트",
    "count_new": "새 게시글 %d개 (최근 %d시간)",
    "count_none": "신규 없음 (최근 %d시간)",
    "status_heading": "피드별 최근 %d시간 등록 현황",
    "status_columns": "최근 %d시간",
    "status_state": "상태",
    "status_count": "%d개",
    "status_zero": "없음",
    "no_new": "최근 %d시간 내 신규 게시글이 없어 최근 글을 요약해서 보냅니다. (라이브 RSS 기준)",
    "no_posts": "게시글을 가져오지 못했습니다.",
    "no_posts_hint": "RSS 연결/권한/피드 상태를 확인해 주세요.",
    "paragraph": "📝 블로그 첫 문단",
    "insights": "💡 핵심 인사이트 (AI Summary)",
    "read": "전체 글 읽기 →",
    "detail_heading": "피드 상세 상태",
    "detail_days": "최근 %d일",
    "mail_new": "신규 %d개",
    "mail_error": "⚠️ RSS 피드 조회 오류",
    "mail_error_hint": "RSS 피드에서 데이터를 가져오지 못했습니다. Logic App 실행 기록을 확인해 주세요.",
    "mail_no_new": "📌 최근 24시간 내 신규 게시글이 없어 최근 글을 요약해서 보냅니다. (라이브 RSS 기준)",
    "legacy_none": "신규 없음 (최근 24시간)",
    "legacy_en": "🔎 EN insights (3줄):",
    "legacy_ko": "💡 KR 인사이트 (3줄):",
    "legacy_unknown": "Unknown Source",
    "untitled": "(no title)",
}
