"""Best-fit packing against one run at a time, and whole rows."""

import collections
import random

from pyspark.sql import functions as F

from feedloom.llm.packing import cheapest, pack, plan_bins

SIZES = (8, 16, 32)


def one_by_one(counts, capacities, overhead):
    """Fill of each bin, packing run after run; and the size each bin is cut down to."""
    bins = []
    for length, n in sorted(counts, reverse=True):
        for k in range(n):
            fits = [(cap - fill, i) for i, (cap, fill) in enumerate(bins) if cap - fill >= length]
            if fits:
                at = min(fits)[1]
            else:
                at = len(bins)
                bins.append([cheapest(length, n - k, capacities, overhead), 0])
            bins[at][1] += length
    return [(min(c for c in capacities if c >= fill), fill) for _, fill in bins]


def test_plan_is_one_by_one():
    rng = random.Random(5)
    for _ in range(200):
        lengths = rng.sample(range(1, 33), rng.randint(1, 12))
        counts = [(x, rng.randint(1, 30)) for x in lengths]
        plan = plan_bins(counts, SIZES, 2)
        want = one_by_one(counts, SIZES, 2)
        got = {}
        for i, start in enumerate(plan.range_start):
            end = plan.range_start[i + 1] if i + 1 < len(plan.range_start) else len(want)
            for b in range(start, end):
                got[b] = (plan.range_capacity[i], plan.range_fill[i])
        assert [got[b] for b in range(len(want))] == want


def check(found, sizes, capacities):
    """Every token of every row has one place; no bin overflows or could be a smaller one."""
    by_row, by_bin = collections.Counter(), collections.defaultdict(list)
    for r in found:
        by_row[r.id] += r.length
        by_bin[r.bin].append(r)
    assert by_row == collections.Counter({k: v for k, v in sizes.items() if v})
    for rows in by_bin.values():
        rows.sort(key=lambda r: r.offset)
        ends = [0]
        for r in rows:
            assert r.offset == ends[-1] and r.length > 0
            ends.append(r.offset + r.length)
        assert {r.fill for r in rows} == {ends[-1]}
        assert {r.capacity for r in rows} == {min(c for c in capacities if c >= ends[-1])}
    assert sorted(by_bin) == list(range(len(by_bin)))
    return by_bin


def test_pack_places_every_token_once(spark):
    rng = random.Random(6)
    sizes = {i: rng.choice([0, 1, 5, 5, 5, 5, 9, 17, 33, 100]) for i in range(400)}
    rows = [(i, "x" * n if i % 50 or n else None, "clash") for i, n in sizes.items()]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, bin STRING")
    found = pack(docs, F.octet_length(F.coalesce("text", F.lit(""))), capacities=SIZES, overhead=2).collect()
    by_bin = check(found, sizes, SIZES)
    runs = collections.Counter(r.length for r in found)
    fills = sorted(one_by_one(runs.items(), SIZES, 2))
    assert sorted((v[0].capacity, v[0].fill) for v in by_bin.values()) == fills
    for i in (k for k, n in sizes.items() if n == 100):
        parts = sorted((r.start, r.length) for r in found if r.id == i)
        assert parts == [(0, 32), (32, 32), (64, 32), (96, 4)]


def test_pack_takes_null_and_repeated_ids_and_nothing(spark):
    docs = spark.createDataFrame([(None, "abc"), (1, "abc"), (1, "abc"), (2, ""), (3, None)], "doc_id BIGINT, text STRING")
    found = pack(docs, F.octet_length(F.coalesce("text", F.lit(""))), capacities=SIZES).collect()
    check(found, {None: 3, 1: 6}, SIZES)
    empty = docs.limit(0)
    assert pack(empty, F.octet_length("text")).count() == 0
