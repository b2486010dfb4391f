"""Bullets, excerpts and insights on edge texts."""

from pyspark.sql import functions as F

from feedloom.functions import lines
from feedloom.functions.constants import BLANK_SUMMARY_BULLETS, EN_FILLERS, KO_UNAVAILABLE, SAFE_LINES
from feedloom.functions.text import lits

C = F.col("c")

def test_extract_bullets(evaluate):
    long = "w" * 161 + "."
    texts = [None, " ", "Short. Tiny.", "This sentence is long enough. And so is this one here!", long, "é" * 141]
    found = evaluate(lines.extract_bullets(C), texts)
    assert found[0] == found[1] == BLANK_SUMMARY_BULLETS
    assert found[2] == ["Short. Tiny.", *EN_FILLERS[:2]]
    assert found[3] == ["This sentence is long enough.", "And so is this one here!", EN_FILLERS[0]]
    assert found[4][0] == "w" * 160 + "..."
    assert found[5][0] == "é" * 141


def test_no_sentence_is_cut_at_140(evaluate):
    text = " ".join(["tiny."] * 40)
    assert evaluate(lines.extract_bullets(C), [text])[0][0] == text[:140] + "..."


def test_normalize_and_sanitize(evaluate):
    rows = [["  ", "(번역 미구성)  가 ", "b"], ["1", "2", "3", "4"], [], None]
    found = evaluate(lines.normalize_bullets(C), rows, "ARRAY<STRING>")
    assert found[0] == ["가", "b", EN_FILLERS[0]]
    assert found[1] == ["1", "2", "3"]
    assert found[2] == found[3] == EN_FILLERS


def test_short_filler_list_repeats_its_last(evaluate):
    assert evaluate(lines.normalize_bullets(C, ["a", "b"]), [[]], "ARRAY<STRING>") == [["a", "b", "b"]]


def test_markers(evaluate):
    found = evaluate(
        lines.strip_bullet_marker(C), ["- a", "* b", "•c", "• 1. d", "12) e", "3| f", "1 . g", "10 h", None]
    )
    assert found == ["a", "b", "•c", "d", "e", "f", "g", "10 h", ""]


def test_punctuation_and_points(evaluate):
    assert evaluate(lines.normalize_punctuation(C), ["“a”  ‘b’ – c — d…", None]) == ["\"a\" 'b' - c - d...", ""]
    assert evaluate(lines.clean_point(C), [" • a\r\nb … ·c", "pâté €5"]) == ["a b ... c", "pté 5"]


def test_unwanted_and_banned(evaluate):
    rows = [
        "• But POINT solutions can only go so far…",
        "But point solutions do help and go so far",
        "A point solution is hold you back",
        "Point solutions are fine",
        None,
        "  ",
    ]
    assert evaluate(lines.unwanted_sentence(C), rows) == [True, True, False, False, False, False]
    assert evaluate(lines.banned_variant(C), rows) == [True, True, True, False, False, False]


def test_lines_in_summary(evaluate):
    given = lits(["In It", " out ", ""])
    found = evaluate(lines.drop_lines_in_summary(given, C), ["what is in it?", " "])
    assert found == [["out"], ["In It", " out ", ""]]


def test_excerpt_three_tops_up(evaluate):
    page = lits(["Page line."])
    found = evaluate(lines.excerpt_three(page, C), ["Sum one. Sum two. Sum three.", "", "page line. x"])
    assert found[0] == ["Page line.", "Sum one.", "Sum two."]
    assert found[1] == ["Page line."]
    assert found[2] == ["page line.", "x", "page line. x"]


def test_korean_lines(spark):
    rows = spark.createDataFrame(
        [(["- 하나", "둘"], "u"), (["english"], "u"), (None, " ")], "ko ARRAY<STRING>, link STRING"
    )
    text = F.lit("Fallback sentence one. Fallback sentence two.")
    out = lines.insights_ko(F.col("ko"), lines.excerpt_lines(text, 8), text, F.col("link"))
    found = [r[0] for r in rows.select(out).collect()]
    assert found[0] == ["하나", "둘", "Fallback sentence one."]
    assert found[1] == [KO_UNAVAILABLE[0], KO_UNAVAILABLE[1], "원문을 확인하세요: u"]
    assert found[2][2] == "원문을 확인하세요."


def test_english_lines_without_any_text(evaluate):
    none = F.array().cast("array<string>")
    assert evaluate(lines.insights_en(none, none, C), [""]) == [SAFE_LINES]
