"""Replays and late repeats on streams."""

import datetime as dt

from pyspark.sql import functions as F

from feedloom.operators import posts as pst
from feedloom.operators.state import ProcessedPosts, to_state_rows
from feedloom.session import shared_dir
from feedloom.streaming import streams as stm

NOW = dt.datetime(2024, 1, 3, 12)
SCHEMA = "title STRING, link STRING, source_name STRING, summary STRING, published TIMESTAMP, fetched_at TIMESTAMP"


def later(days):
    return NOW + dt.timedelta(days=days)


def feed(spark, tmp_path, *batches):
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return stm.payload_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)


def test_repeat_in_a_later_batch_is_dropped(spark, tmp_path):
    posts = feed(
        spark,
        tmp_path,
        [("a", "l1", "S", "x", NOW, NOW), ("f", "l9", "S", "x", NOW + dt.timedelta(days=366), NOW)],
        [("b", "l1", "S", "x", NOW, later(1)), ("c", "l1", "T", "x", NOW, later(1))],
        [("d", "l2", "S", "x", NOW, later(2))],
        [("e", "l3", "S", "x", NOW, later(3))],
    )
    out = str(tmp_path / "out")
    stm.run_append(stm.stream_dedup(posts), out, str(tmp_path / "check"))
    rows = spark.read.parquet(out).collect()
    assert sorted(r.title for r in rows) == ["a", "c", "d", "e", "f"]


def test_repeat_after_a_month_and_a_restart_is_dropped(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stm.on_disk_state(spark)
    try:
        path, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
        known = pst.with_keys(spark.createDataFrame([("S", "l0")], "source_name STRING, link STRING")).select("pk", "rk")
        batches = [
            [("a", "l1", "S", "x", NOW, NOW), ("known", "l0", "S", "x", NOW, NOW), ("other", "l0", "T", "x", NOW, NOW)],
            [("b", "l2", "S", "x", NOW, later(400))],
            [("again", "l1", "S", "x", NOW, later(430)), ("again", "l2", "S", "x", NOW, None), ("c", "L1", "S", "x", None, later(1))],
        ]
        for rows in batches:  # a start of the stream for each
            spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(path)
            posts = stm.payload_stream(spark, path, spark.read.parquet(path).schema)
            stm.run_append(stm.stream_dedup(posts, known), out, check)
        assert sorted(r.title for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "other"]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_bounded_state_forgets(spark, tmp_path):
    posts = feed(
        spark,
        tmp_path,
        [("a", "l1", "S", "x", NOW, NOW)],
        [("b", "l1", "S", "x", NOW, later(1)), ("c", "l2", "S", "x", NOW, later(30))],
        [("d", "l3", "S", "x", NOW, later(31))],
        [("e", "l3", "S", "x", NOW, later(31))],
    )
    out = str(tmp_path / "out")
    stm.run_append(stm.stream_dedup(posts, delay="7 days"), out, str(tmp_path / "check"))
    assert sorted(r.title for r in spark.read.parquet(out).collect()) == ["a", "c", "d"]


def test_replayed_batch_leaves_the_state_as_it_was(spark, tmp_path):
    state = ProcessedPosts(spark, str(tmp_path / "state"))
    none = F.array().cast("array<string>")
    write = stm.upsert_batch(state, "posts")
    rows = spark.createDataFrame([("a", "l1", "S", "x", NOW, NOW), ("b", "l1", "S", "x", NOW, NOW)], SCHEMA)
    full = to_state_rows(
        rows.withColumns({"english_summary": none, "korean_summary": none}), F.col("published")
    )
    write(full, 0)
    write(full, 0)
    assert [r.title for r in state.rows().collect()] == ["a"]


def test_replayed_batch_of_the_chain_keeps_its_own_rows(spark, tmp_path):
    state = ProcessedPosts(spark, str(tmp_path / "state"))
    feeds = spark.createDataFrame([("f", "g", 0, "S", None)], "feed_id STRING, feed_group STRING, feed_pos INT, source_name STRING, emoji STRING")
    items = spark.createDataFrame(
        [("f", 0, NOW, "a", "l1", "x", NOW), ("f", 1, NOW, "undated", "l2", "x", None)],
        "feed_id STRING, item_pos INT, fetched_at TIMESTAMP, title STRING, link STRING, summary STRING, published TIMESTAMP",
    )
    sink = stm.items_to_state(state, feeds, "w")
    sink(items, 0)
    sink(items, 0)
    sink(items.withColumn("title", F.lit("again")), 1)
    assert [r.title for r in state.rows().collect()] == ["a"]


def counted(spark, *times):
    return spark.createDataFrame([("f", t) for t in times], "feed_id STRING, published TIMESTAMP")


def totals(sums):
    return sorted(r["items"] for r in sums.read().collect())


def test_batch_meets_the_settled_keys_of_the_state(spark, tmp_path, monkeypatch):
    """The keys that the table holds of a batch have a known size, so texts need not move to meet them."""
    state = ProcessedPosts(spark, str(tmp_path / "state"))
    feeds = spark.createDataFrame([("f", "g", 0, "S", None)], "feed_id STRING, feed_group STRING, feed_pos INT, source_name STRING, emoji STRING")
    kinds = "feed_id STRING, item_pos INT, title STRING, link STRING, summary STRING, published TIMESTAMP, categories ARRAY<STRING>, fetched_at TIMESTAMP"
    now = dt.datetime(2024, 1, 3)
    found, write = [], state._write

    def spy(rows):
        found.append(rows._jdf.queryExecution().optimizedPlan().toString() + rows._jdf.queryExecution().executedPlan().toString())
        found.append([f for f in rows.inputFiles() if "/seen-" in f])
        return write(rows)

    monkeypatch.setattr(state, "_write", spy)
    sink = stm.items_to_state(state, feeds, "w")
    for batch, links in enumerate((["a", "b"], ["b", "c"])):
        sink(spark.createDataFrame([("f", i, x, x, x, now, [], now) for i, x in enumerate(links)], kinds), batch)
    assert sorted(r.link for r in state.rows().collect()) == ["a", "b", "c"]
    assert found[3] and "LeftAnti" in found[2]


def test_hourly_sums_lose_no_late_row(spark, tmp_path):
    sums = stm.StreamedSums(spark, str(tmp_path / "sums"), ["hour", "feed_id"], fan=2)
    write = sums.sink(stm.hourly_status)
    times = [NOW, later(400), NOW - dt.timedelta(days=9), NOW, later(-9)]
    for i, t in enumerate(times):
        write(counted(spark, t), i)
    for i in range(len(times)):
        write(counted(spark, times[i]), i)  # none counts again
    assert totals(sums) == [1, 2, 2]
    assert {r["items"] for r in stm.status_windows(sums.read()).collect()} == {1, 2}
    anew = stm.StreamedSums(spark, str(tmp_path / "anew"), ["hour", "feed_id"])
    sums.hand_over(anew)
    assert totals(anew) == [1, 2, 2]
    anew.sink(stm.hourly_status)(counted(spark, NOW), 0)
    assert totals(anew) == [1, 2, 3]


def test_few_folders_are_read_however_many_batches(spark, tmp_path):
    sums = stm.StreamedSums(spark, str(tmp_path / "sums"), ["hour", "feed_id"], fan=3)
    write = sums.sink(stm.hourly_status)
    batch = counted(spark, NOW, NOW)
    for i in range(29):
        write(batch, i)
        assert totals(sums) == [2 * (i + 1)]
        assert len(sums._largest(sums._written())) <= 2 * 4
    assert sums._largest(sums._written()) == [(0, 26), (27, 27), (28, 28)]
    # What was put together is gone once the next batch has come.
    assert len(sums._written()) == 3


def test_crash_while_sums_are_put_together(spark, tmp_path, monkeypatch):
    sums = stm.StreamedSums(spark, str(tmp_path / "sums"), ["hour", "feed_id"], fan=2)
    write = sums.sink(stm.hourly_status)
    write(counted(spark, NOW), 0)

    def fails(first, last):
        raise RuntimeError("lost")

    monkeypatch.setattr(sums, "_fold", fails)
    try:
        write(counted(spark, NOW), 1)
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert totals(sums) == [2]
    write(counted(spark, NOW), 1)
    write(counted(spark, NOW), 2)
    assert totals(sums) == [3] and sums._written() == [(0, 1), (2, 2)]


def test_every_payload_is_an_item_or_a_reject(spark):
    item = "<item><title>t</title><link>l</link><pubDate>{}</pubDate></item>"
    rss = "<?xml version='1.0'?><rss><channel><title>c</title>{}</channel></rss>"
    day = "Wed, 03 Jan 2024 10:00:00 GMT"
    rows = [
        ("ok", NOW, 200, rss.format(item.format(day) + item.format("?")), None, 1),
        ("empty", NOW, 200, rss.format(""), None, 1),
        ("down", NOW, 503, rss.format(item.format(day)), None, 1),
        ("lost", NOW, None, None, "timeout", 1),
        ("html", NOW, 200, "<html><body>x</body></html>", None, 1),
        ("text", NOW, 200, "nothing", None, 1),
        ("null", NOW, 200, None, None, 1),
    ]
    from feedloom import schemas

    found = stm.stream_outcomes(spark.createDataFrame(rows, schemas.FEED_PAYLOADS))
    got = {(r.feed_id, r.item_pos, r.kind, r.reason, r.link) for r in found.collect()}
    assert found.count() == len(got) and got == {
        ("ok", 0, "item", None, "l"),
        ("ok", 1, "reject", "no readable date", "l"),
        ("empty", None, "reject", "no items", None),
        ("down", None, "reject", "HTTP 503", None),
        ("lost", None, "reject", "timeout", None),
        ("html", None, "reject", "HTML instead of XML", None),
        ("text", None, "reject", "Not XML format", None),
        ("null", None, "reject", "Not XML format", None),
    }


def test_shared_dir_is_below_the_named_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = shared_dir(spark, "x")
    assert path != shared_dir(spark, "x")
    if root:
        assert path.startswith(root)
