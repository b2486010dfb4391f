"""Main text of pages and the quality classifier."""

import itertools
import random
import zlib

import numpy as np
import pytest

from feedloom.llm import html_text, quality


def cost(labels, scores, edges):
    return sum(abs(s) for s, x in zip(scores, labels) if (s > 0) != x) + sum(w for a, b, w in edges if labels[a] != labels[b])


def test_the_cut_is_the_cheapest_labelling():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 9)
        scores = [rng.choice([-3, -1.5, -0.2, 0.3, 1, 4]) for _ in range(n)]
        edges = [(a, b, rng.choice([0.1, 0.5, 2.0])) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4]
        best = min(cost(x, scores, edges) for x in itertools.product((False, True), repeat=n))
        assert np.isclose(cost(html_text.minimum_cut(scores, edges), scores, edges), best)


PAGES = [
    ("", ""), (None, ""), ("   ", ""), ("just words here", "just words here"),
    (
        '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>'
        '<div class="ad">Buy now, buy all.</div><article><h1>Title</h1><p>One &amp; two<br>three.<p>Four <b>bold</b>ly &#8212;\n five.</p>'
        "<script>var x='<p>no</p>'</script></article><footer>&copy; us</footer></body></html>",
        "Title One & two three. Four boldly — five.",
    ),
    (
        '<body><header><div>Site name</div><a href=/>Home</a></header><main><p>First paragraph of the story, which is long enough.</p>'
        '<aside><p>Related: another story</p></aside><form><label>Mail</label><input><button>Send</button></form>'
        '<p>Second paragraph.</p></main><section id="comments"><p>Great read, thank you for this, I liked it a lot!</p></section>'
        '<div class="cookie-notice">We use cookies on this site to make it better for all of you.</div></body>',
        "First paragraph of the story, which is long enough. Second paragraph.",
    ),
    (
        "<div id=menu><a>One</a> <a>Two</a></div><div id=content><p>Text of a page without an article element, some words long.</p>"
        "<ul><li>first point</li><li>second point</li></ul><table><tr><td>cell</td><td>other</td></tr></table></div><div class='sidebar'><p>Side words</p></div>",
        "Text of a page without an article element, some words long. first point second point cell other",
    ),
    (
        '<body><div class="topNav"><a href=/>Home</a></div><article><header class="x"><h1>Head</h1></header><p>Some words of an article that is told here at length.</p>'
        '<div class="ad-box">A very long advert with a great many words in it, so that its length speaks for it as much as length can, and yet more words.</div>'
        "<p>To.</p><p>All rights reserved.</p><ul><li>one</li><li><a href=x>two</a></li></ul></article><div role='complementary'><p>Side text of some length</p></div>"
        "<div id='userComments'><div class='comment'><p>I think this is a very good article and I have a lot to say about it.</p></div></div></body>",
        "Head Some words of an article that is told here at length. To. All rights reserved. one two",
    ),
    ("<body><nav><ul><li>Home</li></ul></nav><p>Short.</p><footer>Imprint</footer></body>", "Short."),
    ("<article><p>cut off in the mid", "cut off in the mid"), ("<article><p>a <b>b <i>c</article> <p>", "a b c"),
    ("<article>" + "<p>word &lt;tag&gt; word.</p>" * 3000 + "</article>", " ".join(["word <tag> word."] * 3000)),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
]


def test_pages(spark):
    rows = [(i, f"u{i}", html, "clash") for i, (html, _) in enumerate(PAGES)] + [(None, None, PAGES[4][0], None)]
    frame = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, TEXT STRING")
    found = html_text.extract_main_text(frame)
    assert found.columns == ["page_id", "url", "html", "text"]
    got = {r.page_id: r.text for r in found.collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i] == want
    assert got[None] == PAGES[4][1]
    assert html_text.extract_main_text(frame.limit(0)).count() == 0


STORY = "<article><h1>Head</h1><p>Some words of an article that is told here at length.</p><p>To be continued.</p></article>"
TOLD = "Head Some words of an article that is told here at length. To be continued."
COMMENTS = "<section id=comments>" + "<p>I think this is a very good article and I have a lot to say.</p>" * 9 + "</section>"
OPEN_HEADS = [
    f"<html><head><title>T</title><meta charset=utf-8><body>{STORY}</body></html>",
    f"<head><title>T</title><style>p{{}}</style><noscript><link href=x></noscript>{STORY}",
    f"<head><link rel=x><script>var x='<p>no</p>'</script><div>{STORY}</div>",
    f"<head><title>T</title><template><p>no</p></template><header>Site</header>{STORY}",
]
WRAPPED = [
    f"<body><form id=aspnetForm><nav><a href=/>Home</a></nav>{STORY}<label>Mail</label></form><footer>us</footer></body>",
    f"<div class='container no-sidebar'><div class=has-comments>{STORY}{COMMENTS}</div></div><div class=cookie-notice>We use cookies.</div>",
    f"<div class='container no-sidebar'><main><div>{STORY}</div></main><div class=sidebar>Side words</div></div>{COMMENTS}",
    f"<form><div class=has-comments>{STORY.replace('article>', 'div>')}</div></form>",
    f"{STORY}{COMMENTS}<div class=related><article>Other story</article></div>",
    f"<div>{STORY.replace('article>', 'div>')}</div><aside><article>Other story</article></aside><div class=related><article>Third</article></div>",
    f"<article>{STORY[9:-10]}<div class=comments><p>I like it.</p></div></article>",
]


@pytest.mark.parametrize("html", OPEN_HEADS + WRAPPED)
def test_open_heads_and_wrappers_lose_nothing(html):
    assert html_text.main_text(html) == TOLD
    blocks = html_text.read_blocks(html)
    scores, edges = [html_text.content_score(b) for b in blocks], html_text.ties(blocks)
    best = min(cost(x, scores, edges) for x in itertools.product((False, True), repeat=len(blocks)))
    assert np.isclose(cost(html_text.minimum_cut(scores, edges), scores, edges), best)


def test_given_pages_hold_their_article(spark, sf):
    import re
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_text.op6_html_extraction(spark, sf).collect():
        inner = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        want = " ".join(unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert r.text == want and r.n_chars == len(want)


def test_risk_stays_non_negative_and_learns():
    rng = np.random.default_rng(5)
    good, bad = rng.normal(1.0, 1, size=(3000, 4)), rng.normal(-1.0, 1, size=(600, 4))
    x = np.vstack([good[1000:], bad])
    model = quality.fit_nnpu(good[:1000].astype(np.float32), x.astype(np.float32), 2000 / 2600)
    right = np.concatenate([model.scores(good[1000:]) >= 0.5, model.scores(bad) < 0.5])
    assert right.mean() > 0.95
    none = quality.fit_nnpu(np.empty((0, 4)), x, 0.7)
    assert np.allclose(none.scores(x), 0.7)


@pytest.fixture(scope="module")
def judged(spark):
    return quality.op1_quality_classifier(spark, "/root/testdata/sf0.1").toPandas()


def test_held_out_accuracy(spark, judged):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert (judged.held_out == judged.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert judged.score.between(0, 1).all() and ((judged.score >= 0.3) == (judged.predicted == 1)).all()
    both = judged[judged.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.95
    good, bad = both[both.quality == 1].score.to_numpy(), both[both.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97


def test_edge_rows(spark):
    rows = [(i, t) for i, t in enumerate(["good plain words here.", None, "", " ", "$$$ !!! ###", "x" * 100_000] * 6)] + [(None, "a"), (1, "b")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").selectExpr("*", "'x' AS Score")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (3, None, 0), (2, 1, 1)], "doc_id BIGINT, quality INT, toxic INT")
    found = quality.judge(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.judge(docs, labels.limit(0)).collect()} == {0.5}


def test_the_held_out_fold_and_other_columns_teach_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "0 AS toxic")
    a, b = quality.train(docs, labels), quality.train(docs.drop("lang", "source"), other)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias
