"""Markup and entity rules on edge texts."""

from html.entities import name2codepoint

from pyspark.sql import functions as F

from feedloom.functions import html, text

C = F.col("c")


def test_decode(evaluate):
    rows = ["&amp;lt;", "&#8217;", "&zz;", "&amp x", "&#x1F6E1;", "&#0;", "&#xD800;", "&apos;&nbsp;&AMP;", "a&b;c", None]
    assert evaluate(html.html_decode(C), rows) == [
        "&lt;", "’", "&zz;", "&amp x", "🛡", "&#0;", "&#xD800;", "'\xa0&AMP;", "a&b;c", None,
    ]


def test_decode_knows_all_names(evaluate):
    names = sorted(name2codepoint)
    found = evaluate(html.html_decode(C), [f"<&{n};>" for n in names])
    assert found == [f"<{chr(name2codepoint[n])}>" for n in names]


def test_encode(evaluate):
    assert evaluate(html.html_encode(C), ["<a href='x'>&\"</a>", "é한🛡", "plain"]) == [
        "&lt;a href=&#39;x&#39;&gt;&amp;&quot;&lt;/a&gt;", "&#233;한&#128737;", "plain",
    ]


def test_tags_over_two_lines_survive_the_lazy_rule(evaluate):
    rows = ["<p>a</p> <b\n>c</b>", "a < b > c", None]
    assert evaluate(html.strip_tags_lazy(C), rows) == ["a <b\n>c", "a  c", ""]
    assert evaluate(html.strip_tags_full(C), rows) == ["a c", "a c", ""]


PAGES = [
    '<div class="entry-content">E</div><p id="1" class=\'wp-block-paragraph\'>  P &amp; <b>q</b> </p>',
    '<DIV class="entry-content">E\n1</DIV><article>A</article>',
    '<p class="wp-block-paragraph big">no</p><article x="1">A</article>',
    '<p class="wp-block-paragraph">  </p><article>A</article>',
    '<div class="post-content">D</div>',
    "<p>nothing</p>",
    "<article>" + "y" * 801 + "</article>",
    None,
]


def test_first_paragraph(evaluate):
    assert evaluate(html.first_paragraph_page(C), PAGES) == [
        "P & q", "E\n1", "A", "", "D", "", "y" * 800 + "...", "",
    ]


def test_main_content(evaluate):
    big = "<p>" + "z" * 70000
    rows = [
        "<nav></nav><div id=1><DIV class='entry-content'>body</div></article>tail entry-content",
        "entry-content no div</article>",
        "<div>entry-content open",
        "<div a>entry-content" + "k" * 70000,
        "x<article>in</article>y",
        "x<article>open",
        big,
        None,
    ]
    found = evaluate(html.main_content_html(C), rows)
    assert found[:3] == [
        "<DIV class='entry-content'>body</div>", "entry-content no div", "<div>entry-content open",
    ]
    assert found[3] == rows[3][:60000]
    assert found[4:] == ["<article>in", "x<article>open", big[:60000], ""]


def test_readable_text(evaluate):
    page = "<script>a\nb</script><STYLE>s</STYLE><!-- c\nd --><h1>T</h1><p>one<br>two&amp;</p>\r\n\r\n\r\n<i>x</i>  \t y"
    assert evaluate(html.readable_text(C), [page, None]) == ["T\n\none\ntwo&\n\n x y", ""]


def test_boilerplate(evaluate):
    rows = ["keep\n Search here \n\nthe BEST PRACTICES\nPost | Microsoft Security Blog\n  also ", "\n".join(map(str, range(250)))]
    found = evaluate(html.drop_boilerplate_lines(C), rows)
    assert found == ["keep\nalso", "\n".join(map(str, range(200)))]


def test_first_sentence(evaluate):
    rows = [
        "Short one. Second one. Third.",
        "a" * 99 + ". Next. More.",
        "a" * 98 + ". Next. More.",
        "Only.",
        "No stop " + "b" * 600,
        "c" * 700 + ". d",
        "1.5 is no end. Yes. Z",
        "Line\nbreak. x",
        "",
        None,
    ]
    assert evaluate(html.first_sentence_paragraph(C), rows) == [
        "Short one. Second one.",
        "a" * 99 + ".",
        "a" * 98 + ". Next.",
        "Only.",
        ("No stop " + "b" * 600)[:500] + "...",
        "c" * 600 + "...",
        "1.5 is no end. Yes.",
        "Line\nbreak. x",
        "",
        "",
    ]


def test_paragraph_chain(evaluate):
    long = "x\n" + "y" * 700
    found = evaluate(html.first_paragraph_chain(F.lit(" "), C), ["One. Two. T", long, ""])
    assert found == ["One. Two.", long[:500] + "...", ""]
    assert evaluate(html.first_paragraph_chain(F.lit("P"), C), ["One."]) == ["P"]


def test_lengths_count_utf16_units(evaluate):
    rows = ["🛡️a", "🛡🛡🛡", "ab"]
    assert evaluate(text.len_u16(C), rows) == [4, 6, 2]
    assert evaluate(text.cut_u16(C, 3), rows) == ["🛡️", "🛡", "ab"]
    assert evaluate(text.clip(C, 5, "..."), rows) == ["🛡️a", "🛡🛡...", "ab"]


def test_trim_and_blank(evaluate):
    rows = [" \xa0 a　\r\n", "\x85\t", "", None]
    assert evaluate(text.trim_u(C), rows) == ["a", "", "", None]
    assert evaluate(text.is_blank(C), rows) == [False, True, True, True]
    assert evaluate(text.collapse_ws(C), ["a \n b"]) == ["a b"]


def test_cuts(evaluate):
    assert evaluate(html.build_excerpt(C), ["e" * 360, "e" * 361, None]) == ["e" * 360, "e" * 360 + "...", ""]
    assert evaluate(html.summary_cut(C), ["s" * 400, "s" * 401]) == ["s" * 400, "s" * 400 + "..."]
    assert evaluate(text.truncate_log(C), ["a\r\nb", "l" * 401, None]) == ["a  b", "l" * 400 + "...", ""]
    assert evaluate(text.truncate_log_long(C), ["l" * 1001]) == ["l" * 1000 + "...[truncated]"]


def test_emoji(evaluate):
    assert evaluate(html.emoji_entities(C), ["🛡️", "☁x", "", None]) == [
        "&#55357;&#57057;&#65039;", "&#9729;x", "&#128240;", "&#128240;",
    ]


def test_scrub(evaluate):
    far = "k" * 250
    rows = [
        "<p>But Point Solutions can only go so far. Rest</p>",
        f"<p>{far}point solutions can only go so far</p>",
        "point solutions can only go so far.point solutions can only go so far.z",
        "<p>none</p>",
    ]
    assert evaluate(html.scrub_phrase(C), rows) == ["<p> Rest</p>", f"<p>{'k' * 50}</p>", "z", "<p>none</p>"]


def test_hangul(evaluate):
    assert evaluate(html.contains_hangul(C), ["a가", "ㄱ", "힣", "", None]) == [True, False, True, False, False]
