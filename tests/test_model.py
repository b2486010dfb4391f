"""Model answers and caller JSON in all shapes."""

import json

from pyspark.sql import functions as F

from feedloom import schemas
from feedloom.functions import json_cols as jsn
from feedloom.functions.constants import KO_FILLERS, MISSING_EN, MISSING_KO
from feedloom.operators import insights as ins
from feedloom.plans import mail

C = F.col("c")


def body(content):
    return json.dumps({"choices": [{"message": {"content": content}}]})


def items(*rows):
    return json.dumps({"items": [{"index": i, "koreanSummary": k} for i, k in rows]}, ensure_ascii=False)


def responses(spark, rows):
    return spark.createDataFrame(rows, schemas.MODEL_RESPONSES)


def test_code_fence(evaluate):
    rows = ["```json\n{}\n```", " ``` {} ```", "{}", "```json```{}", "{}```"]
    assert evaluate(jsn.strip_code_fence(C), rows) == ["{}"] * 5


def test_insights(spark):
    good = items((0, ["가", "", "나"]), (-1, ["x"]), (1, []), (0, ["다"]), (2, ["english only"]), (10, ["y"]))
    mixed = json.dumps(
        {
            "items": [
                {"index": "1", "koreanSummary": ["a"]},
                {"index": 1.5, "koreanSummary": ["a"]},
                {"index": 2, "koreanSummary": ["a", 3]},
                {"index": 3, "koreanSummary": [None, "라"]},
                {"koreanSummary": ["a"]},
                {"index": 4, "koreanSummary": "text"},
                7,
            ]
        }
    )
    rows = [
        ("a", 200, body(good)),
        ("b", 200, body("```json\n" + mixed + "\n```")),
        ("c", 429, body(good)),
        ("d", 200, body("no json")),
        ("e", 200, "broken"),
    ]
    found = {(r.digest_id, r["index"]): r.korean_summary for r in ins.parse_insights(responses(spark, rows)).collect()}
    assert found == {
        ("a", 0): ["다", *KO_FILLERS[:2]],
        ("a", 2): ["english only", *KO_FILLERS[:2]],
        ("b", 3): ["라", *KO_FILLERS[:2]],
    }


def test_diagnostics(spark):
    rows = [
        ("ok", 200, body(items((0, ["가"])))),
        ("late", 429, "x"),
        ("blank", 200, body("  ")),
        ("text", 200, body("hello")),
        ("other", 200, body('{"a": 1}')),
        ("none", 200, body(items((0, [])))),
    ]
    answers = responses(spark, rows)
    names = [r[0] for r in rows] + ["unset"]
    runs = spark.createDataFrame([(n,) for n in names], "digest_id STRING")
    posts = spark.createDataFrame([(n, 0, "t") for n in names], "digest_id STRING, index INT, title STRING")
    attached = ins.attach_insights(posts, ins.parse_insights(answers))
    found = {r.digest_id: r for r in ins.diagnostics(runs, answers, attached).collect()}
    assert found["ok"].succeeded and found["ok"].translated_posts == 1
    assert {n: r.error for n, r in found.items()} == {
        "ok": None,
        "late": "HTTP 429",
        "blank": "Empty content in AOAI response",
        "text": "JsonException",
        "other": "Missing 'items' array in AOAI JSON content",
        "none": "AOAI call succeeded but produced no Hangul output",
        "unset": "AOAI_ENDPOINT/AOAI_DEPLOYMENT not set",
    }
    assert not found["unset"].configured


def test_summary_shapes(evaluate):
    rows = [
        '{"ENGLISHSUMMARY": ["a"], "koreanSummary": ["b", null]}',
        '{"englishSummary": null, "koreanSummary": ["b"]}',
        "{}",
        '{"englishSummary": "[\\"a\\", \\"b\\"]", "koreanSummary": "x\\n\\n y "}',
        '{"EnglishSummary": "one line", "koreanSummary": [1]}',
        json.dumps(json.dumps({"englishSummary": ["a"], "KoreanSummary": "k"})),
        '{"englishSummary": 5}',
        "null",
        "oops",
        None,
    ]
    found = evaluate(jsn.parse_summary_lenient(C), rows)
    pairs = [(r.english_summary, r.korean_summary) for r in found]
    missing = ([MISSING_EN], [MISSING_KO])
    assert pairs == [
        (["a"], ["b", None]),
        ([MISSING_EN], ["b"]),
        ([], []),
        (["a", "b"], ["x", "y"]),
        missing,
        (["a"], ["k"]),
        missing,
        missing,
        missing,
        missing,
    ]


def test_first_array(evaluate):
    inner = body('Here: ["p", "q"]')
    rows = [
        'text ["a", "b"] ["c"]',
        '{"z": [1], "y": {"k": ["first", "x"]}, "a": ["second"]}',
        '{"t": "say [\\"no\\"]", "l": [["deep \\" one"], ["two"]]}',
        '{"t": []}',
        "[1, 2]",
        inner,
        "none",
        None,
    ]
    assert evaluate(jsn.first_string_array(C), rows) == [
        ["a", "b"], ["first", "x"], ['deep " one'], None, None, ["p", "q"], None, None,
    ]


def test_requests(spark):
    requests = spark.createDataFrame(
        [
            ("r", json.dumps({"Posts": [
                {"Title": "T", "link": "l", "englishSummary": '["a", 1, "b"]', "KoreanSummary": ["k", 2]},
                {"title": None, "Title": "ignored", "englishSummary": "plain", "koreanSummary": 7},
            ]})),
            ("bad", "{"),
            ("none", '{"posts": 3}'),
        ],
        "request_id STRING, body STRING",
    )
    found = mail.posts_from_requests(requests).orderBy("item_pos").collect()
    assert [(r.title, r.link, r.english_summary, r.korean_summary) for r in found] == [
        ("T", "l", ["a", "b"], ["k"]),
        (None, None, ["plain"], None),
    ]


def test_model_request_is_ordered(spark):
    posts = spark.createDataFrame(
        [("d", 1, "한글", ["b"]), ("d", 0, "A", ["a"])],
        "digest_id STRING, index INT, title STRING, english_summary ARRAY<STRING>",
    )
    sent = json.loads(ins.model_requests(posts).collect()[0].payload)
    assert [i["title"] for i in sent["items"]] == ["A", "한글"]
    assert all(len(i["englishSummary"]) == 3 for i in sent["items"])
