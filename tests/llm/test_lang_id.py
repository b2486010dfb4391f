"""Language of texts: held-out accuracy, subwords by hand, calibration."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import lang_id

WORDS = {
    "en": "the of and that with this from have which their would there been".split(),
    "de": "der die und das nicht mit über schön für straße größe auch wird".split(),
    "fr": "le la été vous être où après très garçon leur même pour sont".split(),
}


def text_of(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", ".", ",", "\n"]) for _ in range(n))


def hashed(piece):
    """Bucket of one subword, by the same arithmetic on single numbers."""
    h = piece[0] + 1
    for b in piece[1:]:
        h = (h * 0x01000193 + b) % 2**32
    h = ((h ^ (h >> 15)) * 0x85EBCA6B) % 2**32
    return (h ^ (h >> 13)) % lang_id.BUCKETS


def plain_counts(text):
    counts = np.zeros(lang_id.BUCKETS, dtype=int)
    raw = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else b if b > 127 else 32 for b in text.encode())
    flat = b" " + b" ".join(raw.split()) + b" " if raw.split() else b""
    for size in (2, 3, 4):
        for i in range(len(flat) - size + 1):
            if b" " not in flat[i + 1 : i + size - 1]:
                counts[hashed(flat[i : i + size])] += 1
    return counts


@pytest.mark.parametrize("text", ["", "1 2 3", "a", "Ab", "Schöne Grüße, WELT 42 x", "wort " * 500, "中文 und \U0001f600"])
def test_subwords_are_those_counted_one_by_one(text, monkeypatch):
    assert (lang_id.subword_counts(text) == plain_counts(text)).all()
    monkeypatch.setattr(lang_id, "STRIDE", 7)
    assert (lang_id.subword_counts(text) == plain_counts(text)).all()


def test_calibration_rejects_what_is_often_wrong():
    rng = np.random.default_rng(1)
    answers = rng.integers(0, 2, 4000)
    sure = rng.random(4000) < 0.7
    # Where the model is not sure it is right three times out of four.
    seen = np.where(sure | (rng.random(4000) < 0.75), answers, 1 - answers)
    logits = np.zeros((4000, 2))
    logits[np.arange(4000), seen] = np.where(sure, 9.0, 5.0)
    model = lang_id.calibrate(lang_id.Model(["a", "b"], np.zeros((1, 1)), np.zeros((1, 2)), np.zeros(2)), logits, answers, 0.99)
    shares = lang_id._softmax(logits / model.temperature).max(axis=1)
    taken = shares >= model.least
    assert (seen == answers)[taken].mean() >= 0.99 and abs(taken.mean() - 0.7) < 0.05
    assert model.temperature > 2  # scores of 0.99 for three out of four were too high
    assert lang_id.calibrate(model, logits[:0], answers[:0]) is model


def test_held_out_texts(spark):
    rng = random.Random(4)
    rows = [(i, text_of(rng, lang, rng.randint(3, 60)), lang, "x") for i, lang in enumerate(random.Random(3).choices(list(WORDS), k=900))]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, LANG_PRED STRING")
    found = lang_id.identify(docs, lang_id.train(docs))
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score", "lang_rejected"]
    held = found.filter(lang_id.fold() == lang_id.HELD_OUT).collect()
    assert len(held) > 150
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.lang_score <= 1 for r in held)


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    rng = random.Random(6)
    rows = [(i, text_of(rng, "en", 20), "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    wrong = docs.withColumn("lang", F.when(lang_id.fold() == lang_id.HELD_OUT, "xx").otherwise(F.col("lang")))
    assert lang_id.train(wrong).langs == ["en"]
    kept = wrong.filter(lang_id.fold() != lang_id.HELD_OUT)
    assert np.array_equal(lang_id.train(wrong).table, lang_id.train(kept).table)


def test_edge_rows(spark):
    rng = random.Random(5)
    rows = [(i, text_of(rng, lang, 30), lang) for i, lang in enumerate(list(WORDS) * 40)]
    edges = [
        (1000, None, "en"), (1001, "", "de"), (1002, " 12 !? \n", "fr"), (None, "the of and that", None),
        (1003, text_of(rng, "de", 60000), None), (1004, rows[0][1], None), (1004, rows[0][1], "en"), (1005, "中文", None),
    ]
    docs = spark.createDataFrame(rows + edges, "doc_id BIGINT, text STRING, lang STRING")
    model = lang_id.train(docs)
    found = {(r.doc_id, r.text): r for r in lang_id.identify(docs, model).collect()}
    for i, text in ((1000, None), (1001, ""), (1002, " 12 !? \n")):
        r = found[i, text]
        assert (r.lang_pred, r.lang_score, r.lang_rejected) == ("und", 0.0, True)
    assert found[None, "the of and that"].lang_pred == "en"
    assert found[1003, edges[4][1]].lang_pred == "de"
    assert found[1004, rows[0][1]].lang_pred == rows[0][2] == found[0, rows[0][1]].lang_pred
    assert found[1005, "中文"].lang_pred in WORDS
    empty = docs.limit(0)
    assert lang_id.identify(empty, lang_id.train(empty)).count() == 0
    assert {r.lang_pred for r in lang_id.identify(docs, lang_id.train(empty)).collect()} == {"und"}


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = lang_id.op11_language_id(spark, sf)
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert found.count() == docs.count()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
