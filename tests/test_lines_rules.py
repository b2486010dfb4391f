"""Line rules on texts whose lines were worked out by hand, and properties that hold for any text."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedloom.functions import lines
from feedloom.functions.constants import SAFE_LINES
from feedloom.functions.text import lits

C = F.col("c")
W10 = "abcdefghi " * 60  # words of nine letters: a space at every tenth place

EXCERPTS = [
    # text, count, lines
    ("", 3, []),
    ("  \n ", 3, []),
    ("First one. Second one! Third one? Fourth.", 3, ["First one.", "Second one!", "Third one?"]),
    ("첫 문장입니다。 둘째입니다！ 셋째？ 끝", 3, ["첫 문장입니다。", "둘째입니다！", "셋째？"]),
    ("Only this.", 3, ["Only this.", "Only this."]),
    ("No stop at all", 1, ["No stop at all"]),
    # one sentence of 599: cut after 299, then again from the start of the text
    (W10.strip(), 1, [W10[:299] + "…"]),
    (W10.strip(), 2, [W10[:299] + "…", W10[:289] + "…"]),
    ("x" * 300, 1, ["x" * 300]),
    ("x" * 301, 1, ["x" * 300 + "…"]),
    ("x" * 301, 2, ["x" * 300 + "…", "x" * 300 + "…"]),
]
CHUNKS = [
    ("", 3, 300, []),
    ("a  b\n c", 3, 300, ["a b c"]),
    ("x" * 200, 2, 90, ["x" * 90 + "…", "x" * 90 + "…"]),
    # the cut at the last space past eighty signs; the next piece begins after it
    (W10.strip(), 2, 100, [W10[:99] + "…", W10[100:199] + "…"]),
    ("y" * 85 + " " + "z" * 20, 3, 100, ["y" * 85 + "…", "z" * 20]),
    ("y" * 70 + " " + "z" * 40, 1, 100, ["y" * 70 + " " + "z" * 29 + "…"]),
]
BANNED = [f"Point solutions may hold you back, part {i}" for i in range(8)]
INSIGHTS = [
    # points, fallback text, lines
    (["one", "two", "three", "four"], "x. y.", ["one", "two", "three"]),
    (["Same", "same", "Other"], "", ["Same", "Other", SAFE_LINES[0]]),
    (BANNED + ["good 1", "good 2", "good 3"], "", ["good 1", "good 2", "good 3"]),
    (["First one."], "First one. And one more. A third.", ["First one.", "And one more.", "A third."]),
    ([], "", SAFE_LINES),
    (["A point solution may be holding you back", "Kept"], "", ["Kept", SAFE_LINES[0], SAFE_LINES[1]]),
]


@pytest.mark.parametrize(("text", "count", "want"), EXCERPTS)
def test_excerpt_by_hand(evaluate, text, count, want):
    assert evaluate(lines.excerpt_lines(C, count), [text]) == [want]


@pytest.mark.parametrize(("text", "count", "limit", "want"), CHUNKS)
def test_chunks_by_hand(evaluate, text, count, limit, want):
    assert evaluate(lines.chunk_lines(C, count, limit), [text]) == [want]


@pytest.mark.parametrize(("points", "text", "want"), INSIGHTS)
def test_insights_by_hand(evaluate, points, text, want):
    own = lits(points) if points else F.array().cast("array<string>")
    found = evaluate(lines.exactly_three_insights(own, lines.excerpt_lines(C, 8), C), [text])
    assert found == [want]


PIECES = st.lists(
    st.sampled_from(["alpha ", "beta. ", "gamma! ", "x" * 95, " ", "\n", "끝。 ", "point solutions can only go so far. ", "Fine line here. "]),
    max_size=30,
).map("".join)


@settings(max_examples=6, deadline=None)
@given(st.lists(PIECES, min_size=20, max_size=40))
def test_properties(texts):
    import conftest

    rows = conftest.SESSION.createDataFrame(list(enumerate(texts)), "i INT, c STRING")
    three = lines.three_insights(F.split("c", "\n"), lines.excerpt_lines(C, 8))
    found = rows.select(
        "c",
        lines.chunk_lines(C, 4, 120).alias("chunks"),
        lines.excerpt_lines(C, 4).alias("excerpt"),
        lines.exactly_three_insights(three, lines.excerpt_lines(C, 8), C).alias("exact"),
    ).collect()
    for r in found:
        flat, at = " ".join(r.c.split()), 0
        for piece in r.chunks:
            bare = piece.removesuffix("…")
            assert len(bare) <= 120 and flat.find(bare, at) >= at
            at = flat.find(bare, at) + len(bare)
        assert len(r.chunks) <= 4 and (len(r.chunks) == 4 or at >= len(flat.rstrip("…")))
        assert len(r.excerpt) <= 4 and all(0 < len(x) <= 301 for x in r.excerpt)
        assert len(r.exact) == 3
        assert not any("point solution" in x.lower() and "go so far" in x.lower() for x in r.exact)
        said = [x.lower() for x in r.exact if x]
        assert len(set(said)) == len(said)
