"""The pipeline stage by stage against plain versions of the operators."""

import pytest
import test_dedup_shards as plain_lines
import test_near as plain_near
import test_packing as plain_packing
import test_pii as plain_pii
from pyspark.sql import functions as F

import corpus_pipeline
from feedloom.llm import pii, quality
from feedloom.session import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
EXTRA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score DOUBLE, _row STRING, _place INT, _text STRING, predicted INT"


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(settle(stage(spark, docs[-1], sf), name))
    return docs


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_columns_stay(steps):
    assert all(d.columns == COLUMNS for d in steps[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "minhash_near_dedup", "pii", "best_fit_packing",
    ]


def test_rejected_documents_go(spark, sf, steps):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(steps[0], labels)
    want = [r for r in rows(steps[0]) if model.scores(quality.features(r[1])[None])[0] >= quality.THRESHOLD]
    assert rows(steps[1]) == want and len(want) < steps[0].count()


def test_shared_lines_go(steps):
    before = rows(steps[1])
    kept, split = plain_lines.clean_lines([r[1] for r in before], 10)
    want = [(r[0], "\n".join(k), r[2], r[3], len("\n".join(k))) for r, k in zip(before, kept)]
    assert rows(steps[2]) == sorted(want, key=str) and any(len(k) < len(s) for k, s in zip(kept, split))


def test_one_near_copy_stays(steps):
    before = rows(steps[2])
    heads = {min(group, key=lambda i: before[i][0]) for group in plain_near.brute(before_texts(before))}
    assert rows(steps[3]) == sorted((before[i] for i in heads), key=str)


def before_texts(before):
    return [(r[0], r[1], None) for r in before]


def test_personal_data_is_masked(steps):
    want = []
    for i, text, lang, source, _ in rows(steps[3]):
        at, out = 0, ""
        for start, kind, stop in plain_pii.base(text):
            if start >= at:
                out += text[at:start] + pii.MASKS[kind]
            at = max(at, stop)
        want.append((i, out + text[at:], lang, source))
    found = [r[:4] for r in rows(steps[4])]
    extra = pii.find_personal(steps[3]).filter(F.size("extra") > 0).count()
    assert extra or found == sorted(want, key=str)
    assert all(r[4] == len(r[1]) for r in rows(steps[4]))


def test_all_bytes_are_packed(steps):
    sizes = {r[0]: len(r[1].encode()) for r in rows(steps[4])}
    found = steps[5].withColumnRenamed("doc_id", "id").collect()
    plain_packing.check(found, sizes, (2048, 4096, 8192, 16384))


def test_run_is_the_stages(spark, sf, steps):
    found = corpus_pipeline.run(spark, sf)
    assert found.columns == steps[5].columns and found.count() == steps[5].count()


def test_edge_rows_pass_every_stage(spark, sf):
    given = [
        (None, "null id text here", "en", "s", 1, 0.5, "r", 1, "t", 0), (1, None, None, None, None, None, None, None, None, None),
        (2, "", "en", "s", 0, 0.5, "r", 1, "t", 0), (2, "", "en", "s", 0, 0.5, "r", 1, "t", 0),
        (3, "plain words " * 30_000, "en", "s", 1, 0.5, "r", 1, "t", 0), (4, "write to a@b.co now", "en", "s", 1, 0.5, "r", 1, "t", 0),
    ]
    docs = spark.createDataFrame(given, EXTRA)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = settle(stage(spark, docs, sf), "edge")
        assert docs.columns == [c.split()[0] for c in EXTRA.split(", ")]
    assert {r.doc_id for r in docs.collect()} == {None, 1, 2, 3, 4}
    assert docs.filter("doc_id = 4").first().text == "write to <EMAIL> now"
    judged = corpus_pipeline.keep_quality(spark, spark.createDataFrame(given, EXTRA), sf)
    assert judged.columns == docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
