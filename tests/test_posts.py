"""Choice of posts, dedup, state table and counts on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedloom import schemas
from feedloom.functions.keys import partition_key, row_key, source_emoji
from feedloom.operators import filters as flt
from feedloom.operators import posts as pst
from feedloom.operators import rows as rws
from feedloom.operators import state as stt
from feedloom.operators import status as sts
from feedloom.plans import digest as dig

C = F.col("c")
NOW = dt.datetime(2024, 1, 3, 12)
POST = (
    "feed_group STRING, feed_id STRING, feed_pos INT, item_pos INT, link STRING, "
    "source_name STRING, published TIMESTAMP, title STRING, summary STRING, emoji STRING"
)


def post(pos, link, hours, feed=0, source="S"):
    when = None if hours is None else NOW - dt.timedelta(hours=hours)
    return ("g", f"f{feed}", feed, pos, link, source, when, f"t{pos}", f"Summary of post {pos} here.", None)


def make(spark, rows):
    return spark.createDataFrame(rows, POST)


def runs(spark, rows=((30, 12, 24),)):
    data = [(f"d{i}", "g", NOW, d, m, h, None) for i, (d, m, h) in enumerate(rows)]
    return spark.createDataFrame(data, schemas.DIGEST_RUNS)


def no_state(spark):
    return spark.createDataFrame([], "pk STRING, rk STRING")


def as_of():
    return F.lit(str(NOW)).cast("timestamp")


def test_clamp(spark):
    asked = runs(spark, ((0, -1, 0), (7, 99, 999), (-5, 30, 168)))
    found = [
        (r.days_since, r.max_items, r.new_window_hours)
        for r in flt.clamp_params(asked).orderBy("digest_id").collect()
    ]
    assert found == [(30, 12, 24), (7, 30, 168), (30, 30, 168)]


def test_dedup_keeps_newest_then_first(spark):
    rows = [
        post(1, "https://A/x", 5, feed=1),
        post(2, "https://a/X", 3, feed=2),
        post(3, "https://a/x", 3, feed=1),
        post(4, "b", None),
        post(5, "B", 40),
        post(6, " ", 1),
        post(7, None, 1),
    ]
    kept = pst.dedup_by_link(make(spark, rows), [])
    assert sorted(r.item_pos for r in kept.collect()) == [3, 5]
    again = pst.dedup_by_link(kept, [])
    assert sorted(r.item_pos for r in again.collect()) == [3, 5]


def test_cutoffs_are_inclusive(spark):
    rows = make(spark, [post(1, "a", 24), post(2, "b", 24.001), post(3, "c", None), post(4, "d", -1)])
    new = flt.new_window_filter(rows, as_of(), 24)
    assert sorted(r.item_pos for r in new.collect()) == [1, 4]
    assert rows.filter("item_pos < 3").count() == flt.recency_filter(
        rows.filter("item_pos < 4"), as_of(), 2
    ).count()


def test_runs_see_their_window(spark):
    rows = make(spark, [post(1, "a", 24), post(2, "b", 23.99), post(3, "c", 0), post(4, "d", -1)])
    older = make(spark, [post(5, "e", 24.001)])
    for unit in ("hour", "day"):
        seen = pst.runs_to_items(runs(spark), rows.union(older), unit=unit)
        assert sorted(r.item_pos for r in seen.collect()) == [1, 2, 3]
    live = pst.live_items(rows.union(older), as_of(), 24)
    assert sorted(r.item_pos for r in live.collect()) == [1, 2, 3, 4]


def test_window_edge_is_one_rule(spark):
    """An item exactly as old as the window is counted as new and shown."""
    items = make(spark, [post(1, "a", 24), post(2, "b", 24.001)])
    chosen = dig.choose_posts(runs(spark), items, no_state(spark))
    assert [r.item_pos for r in chosen.shown.collect()] == [1]
    listed = runs(spark).select("digest_id", "feed_group", "as_of", "days_since", "new_window_hours", F.lit("f0").alias("feed_id"))
    counted = dig.counts_per_feed(listed, items).collect()[0]
    assert (counted["items"], counted.items_new) == (2, 1)


def test_days_since_cuts_a_longer_window(spark):
    items = make(spark, [post(1, "a", 5), post(2, "b", 24), post(3, "c", 120)])
    chosen = dig.choose_posts(runs(spark, ((1, 12, 168),)), items, no_state(spark))
    assert sorted(r.item_pos for r in chosen.shown.collect()) == [1, 2]
    row = sts.digest_counts(chosen.links, chosen.shown, chosen.runs).collect()[0]
    assert (row.all_items, row.display_posts) == (2, 2)


def test_seen_posts_never_crowd_out_new_ones(spark):
    items = make(spark, [post(i, f"l{i}", i / 10) for i in range(1, 101)])
    state = pst.with_keys(items.filter("item_pos <= 60 OR item_pos > 65")).select("pk", "rk")
    chosen = dig.choose_posts(runs(spark), items, state.union(state))
    found = chosen.shown.orderBy("rank").collect()
    assert [(r.item_pos, r.rank, r.is_new_post) for r in found] == [(60 + i, i, True) for i in range(1, 6)]


def test_new_posts_fall_back_to_recent(spark):
    items = make(spark, [post(i, f"l{i}", i / 4) for i in range(1, 41)])
    first = dig.choose_posts(runs(spark), items, no_state(spark))
    shown = first.shown.orderBy("rank").collect()
    assert [r.item_pos for r in shown] == list(range(1, 13))
    assert all(r.is_new_post for r in shown)
    state = pst.with_keys(items).select("pk", "rk")
    second = dig.choose_posts(runs(spark), items, state)
    again = second.shown.orderBy("rank").collect()
    assert [r.item_pos for r in again] == list(range(1, 11))
    assert not any(r.is_new_post for r in again)
    assert second.new_posts.count() == 0


def test_cap_is_thirty_and_zero_is_default(spark):
    items = make(spark, [post(i, f"l{i}", i / 4) for i in range(1, 41)])
    many = dig.choose_posts(runs(spark, ((30, 99, 24), (30, 0, 24))), items, no_state(spark))
    found = {r.digest_id: r["count"] for r in many.shown.groupBy("digest_id").count().collect()}
    assert found == {"d0": 30, "d1": 12}


def test_counts(spark):
    items = make(spark, [post(1, "A", 1), post(2, "a", 2), post(3, "b", 100), post(4, "c", 9000)])
    chosen = dig.choose_posts(runs(spark), items, no_state(spark))
    row = sts.digest_counts(chosen.links, chosen.shown, chosen.runs).collect()[0]
    assert (row.all_items, row.new_posts, row.display_posts, row.recent_posts) == (2, 1, 1, 1)


def test_empty_digest_keeps_its_row(spark):
    chosen = dig.choose_posts(runs(spark), make(spark, []), no_state(spark))
    row = sts.digest_counts(chosen.links, chosen.shown, chosen.runs).collect()[0]
    assert tuple(row)[1:] == (0, 0, 0, 0)


def test_keys(evaluate):
    assert evaluate(partition_key(C), ["A B  C", None]) == ["ABC", "Unknown"]
    assert evaluate(row_key(C), ["abc"]) == ["ungWv48Bz-pBQUDeXa4iI7ADYaOWF3qctBD_YfIAFa0="]
    assert evaluate(source_emoji(C, "mail"), ["Azure Blog", "nobody", None]) == ["☁️", "📰", "📰"]


def test_state_key_holds_case_and_source(spark):
    rows = make(spark, [post(1, "a/x", 1), post(2, "A/x", 1), post(3, "a/x", 1, source="T")])
    state = pst.with_keys(rows.filter("item_pos = 1")).select("pk", "rk")
    left = pst.unprocessed_posts(rows, state)
    assert sorted(r.item_pos for r in left.collect()) == [2, 3]
    flags = {r.item_pos: r.is_duplicate for r in pst.check_duplicate(rows, state).collect()}
    assert flags == {1: True, 2: False, 3: False}


def state_rows(spark, rows):
    return spark.createDataFrame(rows, schemas.PROCESSED)


def row(pk, rk, title, processed=None, ts=NOW):
    return (pk, rk, title, "l" + rk, pk, "s", "p", '["a"]', None, processed, ts)


def test_upsert_twice_is_once(spark):
    old = state_rows(spark, [row("p", "1", "old", NOW), row("p", "2", "kept", NOW)])
    new = state_rows(
        spark, [row("p", "1", "new", NOW), row("p", "3", "x", NOW - dt.timedelta(1)), row("p", "3", "y", NOW)]
    )
    once = stt.upsert_processed(old, new)
    titles = sorted((r.rk, r.title) for r in once.collect())
    assert titles == [("1", "new"), ("2", "kept"), ("3", "y")]
    twice = stt.upsert_processed(once, new)
    assert sorted((r.rk, r.title) for r in twice.collect()) == titles


def test_stored_state(spark, tmp_path):
    state = stt.ProcessedPosts(spark, str(tmp_path / "state"))
    assert state.rows().count() == 0
    state.append(state_rows(spark, [row("p", "1", "a"), row("p", "2", "b")]), 0)
    state.append(state_rows(spark, [row("p", "1", "c")]), 1)
    state.append(state_rows(spark, [row("p", "1", "c")]), 1)
    before = sorted((r.rk, r.title) for r in state.rows().collect())
    assert before == [("1", "c"), ("2", "b")]
    state.snapshot()
    assert sorted((r.rk, r.title) for r in state.rows().collect()) == before
    state.append(state_rows(spark, [row("p", "2", "folded by now")]), 1)
    assert sorted((r.rk, r.title) for r in state.rows().collect()) == before
    state.append(state_rows(spark, [row("p", "2", "d")]), 2)
    assert sorted((r.rk, r.title) for r in state.rows().collect()) == [("1", "c"), ("2", "d")]
    assert state.keys().count() == 2
    state.snapshot()
    state.clean_up()
    assert sorted((r.rk, r.title) for r in state.rows().collect()) == [("1", "c"), ("2", "d")]
    assert len(list((tmp_path / "state" / "rows").iterdir())) == 1
    assert len(list((tmp_path / "state" / "commits").glob("*.json"))) == 1


def test_writers_count_their_own_versions(spark, tmp_path):
    state = stt.ProcessedPosts(spark, str(tmp_path / "state"))
    state.append(state_rows(spark, [row("p", "1", "batch 0")]), 0)
    state.append(state_rows(spark, [row("p", "2", "stream 0")]), 0, "stream")
    assert state.rows().count() == 2
    state.append(state_rows(spark, [row("p", "1", "batch 2")]), 2)
    state.snapshot()
    state.append(state_rows(spark, [row("p", "3", "other 0")]), 0, "other")
    state.append(state_rows(spark, [row("p", "1", "stream 1")]), 1, "stream")
    state.append(state_rows(spark, [row("p", "9", "replay")]), 0, "stream")
    found = sorted((r.rk, r.title) for r in state.rows().collect())
    assert found == [("1", "stream 1"), ("2", "stream 0"), ("3", "other 0")]


def titles(state):
    return sorted((r.rk, r.title) for r in state.rows().collect())


def test_versions_out_of_order_are_kept(spark, tmp_path):
    state = stt.ProcessedPosts(spark, str(tmp_path / "state"))
    state.append(state_rows(spark, [row("p", "1", "five")]), 5)
    state.snapshot()
    state.append(state_rows(spark, [row("p", "1", "three"), row("p", "2", "three")]), 3)
    assert titles(state) == [("1", "three"), ("2", "three")]
    state.append(state_rows(spark, [row("p", "9", "five again")]), 5)
    assert titles(state) == [("1", "three"), ("2", "three")]
    state.snapshot()
    state.clean_up()
    state.append(state_rows(spark, [row("p", "9", "three again")]), 3)
    state.append(state_rows(spark, [row("p", "3", "four")]), 4)
    assert titles(state) == [("1", "three"), ("2", "three"), ("3", "four")]


def test_version_written_again_keeps_its_turn(spark, tmp_path):
    state = stt.ProcessedPosts(spark, str(tmp_path / "state"))
    state.append(state_rows(spark, [row("p", "1", "a"), row("p", "2", "a")]), 0)
    state.append(state_rows(spark, [row("p", "1", "b")]), 0, "other")
    state.append(state_rows(spark, [row("p", "1", "c")]), 0)
    assert titles(state) == [("1", "b")]


def test_writers_at_once_take_turns_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def write(i):
        mine = stt.ProcessedPosts(spark, str(tmp_path / "state"))
        mine.append(state_rows(spark, [row("p", f"{i}", f"w{i}"), row("p", "all", f"w{i}")]), 0, f"w{i}")

    state = stt.ProcessedPosts(spark, str(tmp_path / "state"))
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(write, range(8)))
    log = state.log.read()
    assert [turn for turn, _ in log] == list(range(8))
    assert sorted(e["writer"] for _, e in log) == [f"w{i}" for i in range(8)]
    assert titles(state) == [*[(f"{i}", f"w{i}") for i in range(8)], ("all", log[-1][1]["writer"])]
    assert not list((tmp_path / "state" / "commits").glob("_draft*"))


def test_turns_are_taken_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from feedloom.operators.commits import CommitLog

    log = CommitLog(spark, str(tmp_path / "log"))
    with ThreadPoolExecutor(8) as pool:
        turns = list(pool.map(lambda i: log.add({"i": i}), range(24)))
    assert sorted(turns) == list(range(24))
    assert {t: e["i"] for t, e in log.read()} == dict(zip(turns, range(24)))


def test_snapshot_beside_other_writers(spark, tmp_path, monkeypatch):
    """What is committed while a snapshot is written stays open; a second snapshot at once gives way."""
    state = stt.ProcessedPosts(spark, str(tmp_path / "state"))
    state.append(state_rows(spark, [row("p", "1", "a")]), 0)
    write = state._write

    def slow(rows):
        folder = write(rows)
        other = stt.ProcessedPosts(spark, str(tmp_path / "state"))
        other.append(state_rows(spark, [row("p", "1", "b"), row("p", "2", "b")]), 0, "other")
        other.snapshot()
        return folder

    monkeypatch.setattr(state, "_write", slow)
    state.snapshot()
    monkeypatch.undo()
    assert titles(state) == [("1", "b"), ("2", "b")]
    assert sum(e["kind"] == "snapshot" for _, e in state.log.read()) == 1
    state.clean_up()
    assert titles(state) == [("1", "b"), ("2", "b")]
    assert len(list((tmp_path / "state" / "rows").iterdir())) == 1


def many(spark, n, title, sql="true"):
    key = F.format_string("%06d", "id")
    columns = [F.lit("p").alias("pk"), key.alias("rk"), F.lit(title).alias("title")]
    rest = [F.lit(str(NOW)).cast("timestamp").alias(c) for c in ("processed_date", "ts")]
    texts = [F.lit("s").alias(c) for c in ("link", "source_name", "summary", "publish_date", "english_summary", "korean_summary")]
    return spark.range(0, n, 1, 4).filter(sql).select(*columns, *texts, *rest)


def plans_written(state, monkeypatch):
    """Plans of the rows that the table writes from now on."""
    found, write = [], state._write

    def spy(rows):
        found.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(rows)

    monkeypatch.setattr(state, "_write", spy)
    return found


def test_snapshot_resolves_without_moving_texts(spark, tmp_path, monkeypatch):
    """Keys and places are shuffled; the rows themselves only once, by day."""
    def keyed(pk, rk, title):
        return (pk, rk, *row("p", "", title)[2:])

    state = stt.ProcessedPosts(spark, str(tmp_path / "state"))
    state.append(many(spark, 70_000, "old"), 0)
    state.append(many(spark, 70_000, "new", "id % 3 = 1 OR id BETWEEN 32760 AND 32775"), 1)
    state.append(state_rows(spark, [keyed("p", None, "null key"), keyed(None, None, "null keys"), keyed("p", "000001", "last")]), 2)
    state.append(state_rows(spark, [keyed("p", None, "null key again")]), 3)
    want = state.rows().select("pk", "rk", "title")
    before = sorted(want.collect(), key=str)
    found = plans_written(state, monkeypatch)
    state.snapshot()
    assert sorted(state.rows().select("pk", "rk", "title").collect(), key=str) == before
    assert len(before) == 70_002 and sum(r.title == "last" for r in before) == 1
    moved = [x for x in found[0].split("\n") if "Exchange" in x and "Broadcast" not in x]
    assert len(moved) == 1 and "REBALANCE" in moved[0]


def test_version_is_shuffled_once(spark, tmp_path, monkeypatch):
    """From the batch of a stream to the files of a version, texts are dealt out by key and no more."""
    from feedloom.streaming.streams import upsert_batch

    state = stt.ProcessedPosts(spark, str(tmp_path / "state"))
    found = plans_written(state, monkeypatch)
    upsert_batch(state, "w")(many(spark, 50, "a").unionByName(many(spark, 50, "b")), 0)
    lines = found[0].split("\n")
    assert len([x for x in lines if "Exchange" in x]) == 1
    # One choice per key: no second window sorts the rows again.
    assert len([x for x in lines if " Window [" in x]) == 1
    assert {r.title for r in state.rows().collect()} == {"a"} and state.rows().count() == 50


def test_stored_rows_are_packed(spark, tmp_path):
    state = stt.ProcessedPosts(spark, str(tmp_path / "state"))
    state.append(many(spark, 20, "a"), 0)
    state.append(many(spark, 20, "b"), 1)
    state.snapshot()
    files = list((tmp_path / "state" / "rows").rglob("part-*.parquet"))
    assert files and all(f.name.endswith(".zstd.parquet") for f in files)


def test_versions_as_ranges():
    from feedloom.operators.commits import covers, with_versions

    some = with_versions({}, [("a", 5), ("a", 3), ("b", 0), ("a", 4), ("a", 9)])
    assert some == {"a": [[3, 5], [9, 9]], "b": [[0, 0]]}
    more = with_versions(some, [("a", 6), ("a", 8), ("a", 7), ("a", 4)])
    assert more["a"] == [[3, 9]] and some["a"] == [[3, 5], [9, 9]]
    assert covers(more, "a", 8) and not covers(more, "a", 2) and not covers(more, "c", 0)


def test_keys_seen_are_those_of_all_keys(spark, tmp_path):
    state = stt.ProcessedPosts(spark, str(tmp_path / "state"))
    assert state.seen(make(spark, [post(1, "l1", 1)])).count() == 0
    old = make(spark, [post(i, f"l{i}", 1) for i in range(40)])
    none = F.array().cast("array<string>")
    full = stt.to_state_rows(old.withColumns({"english_summary": none, "korean_summary": none}), as_of())
    state.append(full.filter("rk < 'M'"), 0)
    state.snapshot()
    state.append(full.filter("rk >= 'M'"), 1)
    posts = make(spark, [post(i, f"l{i}", 1) for i in range(30, 60)] + [post(70, None, 1)])
    flags = {r.item_pos: r.is_duplicate for r in pst.check_duplicate(posts, state.seen(posts)).collect()}
    assert flags == {r.item_pos: r.is_duplicate for r in pst.check_duplicate(posts, state.keys()).collect()}
    assert sorted(i for i, d in flags.items() if d) == list(range(30, 40))
    again = {r.item_pos for r in pst.unprocessed_posts(posts, state.seen(posts, but=("batch", 1))).collect()}
    assert again == {r.item_pos for r in pst.unprocessed_posts(posts, state.keys(but=("batch", 1))).collect()}


def test_key_lookup_reads_its_buckets_and_shuffles_no_state(spark, tmp_path):
    state = stt.ProcessedPosts(spark, str(tmp_path / "state"))
    rows = [row("p", f"{i}", f"t{i}") for i in range(300)]
    state.append(state_rows(spark, rows), 0)
    state.snapshot()
    state.append(state_rows(spark, rows[:9]), 1)
    found = state.seen(make(spark, [post(1, "l1", 1), post(2, "l2", 1)]))
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "bucket#" in x)
    assert "bucket#" in lines[scan].split("PartitionFilters: ")[1].split("]")[0]
    # The keys meet the posts where they lie: nothing is exchanged between their scan and the join.
    join = max(i for i in range(scan) if "BroadcastHashJoin [pk" in lines[i] and "LeftSemi" in lines[i])
    assert not [x for x in lines[join:scan] if "Exchange" in x]


def test_recent_posts_read_their_days(spark, tmp_path):
    state = stt.ProcessedPosts(spark, str(tmp_path / "state"))
    day = dt.timedelta(days=1)
    rows = [row("p", f"{i:02}", f"t{i}", NOW - i * day / 4, NOW - i * day / 4) for i in range(40)]
    state.append(state_rows(spark, rows), 0)
    state.snapshot()
    state.append(state_rows(spark, [row("p", "01", "replaced, stored long ago", NOW, NOW - 30 * day), row("p", "00", "new", NOW, NOW)]), 1)
    state.append(state_rows(spark, [row("p", "39", "late", None, NOW - day / 2), row("p", "no", "undated", None, None)]), 2)
    want = stt.recent_posts(state.rows(), as_of(), 1, 5).collect()
    found = state.recent_posts(as_of(), 1, 5)
    assert found.collect() == want and [r.title for r in want] == ["new", "t2", "late", "t3", "t4"]
    text = found._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in text.split("\n") if "FileScan" in x and "title#" in x]
    assert scans and all("day#" in x.split("PartitionFilters: ")[1].split("]")[0] for x in scans)
    both = state.recent_posts_or_scan(as_of(), 1, 5)
    assert both.collect() == want
    assert titles_of(state.first_rows(500)) == titles(state)
    assert titles_of(state.first_rows(7)) == titles(state)[:7]
    late = F.lit(str(NOW + 90 * day)).cast("timestamp")
    scanned = state.recent_posts_or_scan(late, 91, 3).collect()
    assert scanned == stt.recent_posts_or_scan(state.rows(), late, 91, 3).collect() and len(scanned) == 3
    moved = [row("p", f"{i:02}", f"t{i}", NOW, NOW - 50 * day) for i in range(9)]
    other = stt.ProcessedPosts(spark, str(tmp_path / "other"))
    assert other.recent_posts_or_scan(as_of()).count() == 0
    other.append(state_rows(spark, moved), 0)
    assert other.recent_posts_or_scan(as_of()).collect() == stt.recent_posts_or_scan(other.rows(), as_of()).collect()
    assert other.recent_posts_or_scan(as_of()).count() == 9


def titles_of(rows):
    return sorted((r.rk, r.title) for r in rows.collect())


def test_state_rows_reject_blanks(spark):
    rows = make(spark, [post(1, "", 1), post(2, "a", 1, source=""), post(3, "a", 1), post(4, " ", 1)])
    full = rows.withColumns({"english_summary": F.array(F.lit("가")), "korean_summary": F.lit(None).cast("array<string>")})
    found = stt.to_state_rows(full, as_of()).orderBy("link").collect()
    assert [r.link for r in found] == [" ", "a"]
    assert found[1].english_summary == '["가"]'
    assert found[1].korean_summary == "[]"
    assert found[1].publish_date == "2024-01-03T11:00:00Z"


def test_recent_posts(spark):
    hour = dt.timedelta(hours=1)
    rows = [row("p", f"{i:02}", f"t{i}", NOW - i * hour, NOW - i * hour) for i in range(20)]
    rows += [row("p", "90", "old but stored late", NOW - 99 * hour, NOW), row("p", "91", "no date", None, NOW - 2 * hour)]
    found = stt.recent_posts(state_rows(spark, rows), as_of(), limit=5).collect()
    assert [r.title for r in found] == ["t0", "t1", "t2", "no date", "t3"]
    assert found[0].english_summary == ["a"] and found[0].korean_summary == []
    late = [r.title for r in stt.recent_posts(state_rows(spark, rows), as_of(), limit=99).collect()]
    assert late[-1] == "old but stored late"


def test_scan_when_store_time_finds_nothing(spark):
    stale = NOW - dt.timedelta(days=9)
    rows = [row("p", f"{i:03}", f"t{i}", NOW if i in (3, 501) else stale, stale) for i in range(510)]
    table = state_rows(spark, rows)
    assert stt.recent_posts(table, as_of()).count() == 0
    assert [r.title for r in stt.recent_posts_or_scan(table, as_of()).collect()] == ["t3"]


def test_status(spark):
    feeds = spark.createDataFrame(
        [
            ("d", "f1", None, "u1", 2, None, 5, NOW, 24),
            ("d", "f2", "b", "u2", 1, "HTTP 503", 7, NOW, 24),
            ("d", "f3", "B", "u3", 3, None, 1, NOW, 24),
        ],
        "digest_id STRING, feed_id STRING, source_name STRING, url STRING, feed_pos INT, error STRING, "
        "elapsed_ms BIGINT, as_of TIMESTAMP, new_window_hours INT",
    )
    items = spark.createDataFrame(
        [("d", "f1", NOW), ("d", "f1", NOW - dt.timedelta(hours=25)), ("d", "f2", NOW)],
        "digest_id STRING, feed_id STRING, published TIMESTAMP",
    )
    states = sts.feed_status(feeds, items)
    found = {r.feed_id: (r.source_name, r.ok, r["items"], r.items_new) for r in states.collect()}
    assert found == {"f1": ("Unknown", True, 2, 1), "f2": ("b", False, 0, 0), "f3": ("B", True, 0, 0)}
    assert {r.feed_id: r.position for r in sts.status_by_name(states).collect()} == {"f2": 1, "f3": 2, "f1": 3}
    assert {r.feed_id: r.position for r in sts.status_as_listed(states).collect()} == {"f2": 1, "f1": 2, "f3": 3}


def test_placeholders(spark):
    feeds = spark.createDataFrame([("f0", "S"), ("f9", "T")], "feed_id STRING, source_name STRING")
    rows = rws.placeholder_rows(feeds, make(spark, [post(1, "a", 1)]), as_of())
    assert [(r.feed_id, r.title, r.link) for r in rows.collect()] == [("f9", "No new posts in last 24 hours", "")]
    marked = rows.select("title", "summary", F.lit("d").alias("digest_id"))
    counted = sts.actual_new_count(marked).collect()[0]
    assert (counted.actual_new, counted.shown) == (0, 1)


def test_pages_and_blank_links(spark):
    posts = make(spark, [post(1, "a", 1), post(2, " ", 1), post(3, None, 1), post(4, "z", 1)])
    pages = spark.createDataFrame([("a", "h"), (" ", "no")], "url STRING, html STRING")
    found = {r.item_pos: r.html for r in rws.enrich_pages(posts, pages).collect()}
    assert found == {1: "h", 2: None, 3: None, 4: None}


def test_distinct_lines(spark):
    docs = spark.createDataFrame([(1, ["A", "b", "a", "B", "c"])], "k INT, l ARRAY<STRING>")
    found = rws.distinct_lines(docs, "k", F.col("l")).orderBy("pos").collect()
    assert [r.line for r in found] == ["A", "b", "c"]


@pytest.mark.parametrize(("raw", "points"), [(" 5 ", 5), ("0", 3), ("11", 3), ("x", 3), ("5.0", 3), ("+4", 4), (None, 3), ("10", 10)])
def test_summary_points(evaluate, raw, points):
    assert evaluate(flt.summary_points(C), [raw]) == [points]


def test_empty_content(spark):
    pair = flt.empty_content_summary(F.col("t"), F.col("c"))
    rows = spark.createDataFrame([("a", "b"), (None, "b"), ("a", ""), (" ", "b")], "t STRING, c STRING")
    found = [r.p for r in rows.select(pair.alias("p")).collect()]
    assert found[0] is None and found[3] is None
    assert found[1].english_summary == ["[No content available]"]
    assert found[2].korean_summary == ["[사용 가능한 콘텐츠 없음]"]
