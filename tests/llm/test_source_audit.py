"""Divergence of sources against shares counted one by one."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from feedloom.llm import source_audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, min_docs=3, top=200):
    bags = [(lang or "", source or "", Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for lang, source, text in rows]
    groups = sorted({(lang, source) for lang, source, _ in bags})
    out = []
    for lang in {g[0] for g in groups}:
        df = Counter(t for a, _, b in bags if a == lang for t in b)
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for a, source, bag in bags:
            if a == lang:
                for t in kept:
                    counts[source][t] += bag[t]
                    counts[None][t] += bag[t]

        def shares(of):
            total = sum(counts[of].values()) + len(kept)
            return {t: 1 + 10**9 * (counts[of][t] + 1) // total for t in kept}

        sources = [s for a, s in groups if a == lang]
        p = {s: shares(s) for s in [*sources, None]}
        for s in sources:
            far = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, i) for i, (v, o) in enumerate(sorted(far, key=lambda x: (x[0], x[1].encode())), 1)]
            high = [(-((p[s][t] - p[None][t]) ** 2 // p[None][t]), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            out += [(lang, s, "term", t, -v, i) for i, (v, t) in enumerate(sorted(high, key=lambda x: (x[0], x[1].encode()))[:top], 1)]
    return sorted(out)


def audited(spark, rows, **more):
    docs = spark.createDataFrame(rows, "lang STRING, source STRING, text STRING").repartition(3)
    return sorted(tuple(r) for r in source_audit.audit_sources(docs, **more).collect())


def made(rng, n, langs=("en", "de"), sources=7, words=300):
    pool = [rng.choice(["a", "ä", "B", "中", "\U0001f600", "z"]) + "".join(rng.choices("abcd", k=rng.randint(0, 4))) for _ in range(words)]
    shares = [1 / (i + 1) for i in range(words)]
    rows = []
    for _ in range(n):
        source = min(int(rng.expovariate(0.5)), sources - 1)
        moved = shares[source * 5 :] + shares[: source * 5]
        rows.append((rng.choice(langs), f"s{source}", " ".join(rng.choices(pool, moved, k=rng.randint(0, 60)))))
    return rows


@pytest.mark.parametrize("top", [3, 25])
def test_values_are_those_counted_one_by_one(spark, top, monkeypatch):
    rows = made(random.Random(top), 300)
    assert audited(spark, rows, top=top) == plain(rows, top=top)
    # Small tiles, few rows held.
    for name, value in (("TILE_TERMS", 16), ("TILE_SOURCES", 2), ("HELD", 50), ("CHUNK", 8), ("FAN", 2)):
        monkeypatch.setattr(source_audit, name, value)
    assert audited(spark, rows, top=top) == plain(rows, top=top)


def kept_of(points, k, step):
    band = source_audit.Skyband(k)
    for lo in range(0, len(points), step):
        part = points[lo : lo + step]
        band.add(pa.array([x[2] for x in part]), np.array([-x[0] for x in part]), np.array([x[1] for x in part]))
    return list(zip((-band.n).tolist(), band.ln.tolist(), band.term.to_pylist()))


@pytest.mark.parametrize("letters, lengths, most", [("abcdefghé\U0001f600", 2, 60), ("abcde", 5, 2400)])
def test_skyband_has_what_has_few_above(letters, lengths, most, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(source_audit, "CHUNK", 100)
    for k in (1, 2, 20):
        for _ in range(30 if most < 100 else 1):
            terms = {"".join(rng.choices(letters, k=lengths)) for _ in range(rng.randint(most // 2, most))}
            points = sorted((-rng.randint(1, most // 12), rng.randint(1, most // 10), t) for t in terms)
            above = [sum(a[0] <= b[0] and a[1] <= b[1] and a[2] < b[2] for a in points) for b in points]
            want = [x for x, n in zip(points, above) if n < k]
            assert kept_of(points, k, rng.randint(1, most)) == want


def test_edge_rows(spark):
    word = "one two two three"
    rows = [
        ("en", "a", word), ("en", "a", word), ("en", "b", word), ("en", "b", None), ("en", None, "One TWO"), ("en", "c", ""), ("en", "d", "12 !"),
        (None, "a", word), (None, None, None), ("fr", "x", "seul"), ("fr", "y", "seul"), ("en", "e", "three " * 300_000),
    ]
    want = plain(rows)
    assert audited(spark, rows) == want
    assert {x[4] for x in want if x[0] == "fr"} == {0}  # nothing is kept there
    assert audited(spark, rows[:0]) == []
    docs = spark.createDataFrame([(*r, "q", 1, 2) for r in rows], "lang STRING, source STRING, text STRING, term STRING, n INT, p0 INT")
    assert sorted(tuple(r) for r in source_audit.audit_sources(docs).collect()) == want


def test_large_counts_do_not_overflow(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(10**13, 10**14, 10**6), (0, 0, 1), (7, 9, 3)], "n BIGINT, total BIGINT, v BIGINT")
    found = [r[0] for r in rows.select(source_audit._share(F.col("n"), F.col("total"), F.col("v"))).collect()]
    assert found == [1 + 10**9 * (n + 1) // (t + v) for n, t, v in ((10**13, 10**14, 10**6), (0, 0, 1), (7, 9, 3))]
