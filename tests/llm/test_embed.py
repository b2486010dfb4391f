"""Lattice decoding and embedding near-dedup against brute force."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from feedloom.llm import lattice
from feedloom.llm.components import components
from feedloom.llm.embed_dedup import near_vectors


def in_e8(p):
    doubled = np.rint(p * 2).astype(int)
    return np.allclose(p * 2, doubled) and len(set(doubled % 2)) == 1 and round(p.sum()) % 2 == 0


def test_nearest_points_are_lattice_points_and_nearest():
    rng = np.random.default_rng(2)
    x = rng.normal(scale=2, size=(300, 8))
    p = lattice.nearest(x)
    assert all(in_e8(row) for row in p)
    gap = ((x - p) ** 2).sum(axis=1)
    assert gap.max() <= 1 + 1e-9  # the covering radius of E8 is one
    for v in lattice.NEIGHBOURS:
        assert (((x - p - v) ** 2).sum(axis=1) >= gap - 1e-9).all()


def test_there_are_240_neighbours():
    assert len({tuple(v) for v in lattice.NEIGHBOURS}) == 240
    assert all(in_e8(v) and np.isclose((v**2).sum(), 2) for v in lattice.NEIGHBOURS)
    x = np.random.default_rng(1).normal(size=(50, 8))
    p = lattice.nearest(x)
    index, gain = lattice.next_nearest(x, p, 5)
    for i in range(50):
        far = ((x[i] - p[i] - lattice.NEIGHBOURS) ** 2).sum(axis=1) - ((x[i] - p[i]) ** 2).sum()
        assert np.allclose(np.sort(far)[:5], gain[i]) and np.allclose(far[index[i]], gain[i])


def brute(rows, least):
    """n_links and component of each row position."""
    good = {}
    for i, (key, v) in enumerate(rows):
        if key is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        a = np.array(v, dtype=np.float64)
        good[i] = a / np.linalg.norm(a)
    links = {i: [] for i in range(len(rows))}
    for i, j in itertools.combinations(good, 2):
        if len(good[i]) == len(good[j]) and good[i] @ good[j] >= least:
            links[i].append(j)
            links[j].append(i)
    label = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        label[i] = min(keys) if keys else None
    return [(rows[i][0], len(links[i]), label[i]) for i in range(len(rows))]


def around(rng, centre, cosine, n):
    out = []
    for _ in range(n):
        r = rng.normal(size=len(centre))
        r -= (r @ centre) * centre
        out.append(cosine * centre + np.sqrt(1 - cosine**2) * r / np.linalg.norm(r))
    return out


def test_near_vectors_are_brute_force(spark):
    rng = np.random.default_rng(8)
    unit = lambda: (lambda v: v / np.linalg.norm(v))(rng.normal(size=64))
    vectors = [unit() for _ in range(150)]
    for cosine, n in ((0.999, 30), (0.985, 25), (0.978, 20), (0.97, 10)):
        vectors += around(rng, unit(), cosine, n)
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(1000), vectors)]
    rows += [(2000 + i, rows[3][1]) for i in range(5)] + [rows[7], rows[7]]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 64), (3003, [float("nan")] + [1.0] * 63), (3004, [None] + [1.0] * 63),
             (3005, [float("inf")] * 64), (None, rows[3][1]), (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (3008, [1.0]),
             (3009, [1e-30 * x for x in rows[9][1]]), (3010, [-0.0] * 63 + [1.0]), (3011, [0.0] * 63 + [2.0])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id BIGINT, embedding ARRAY<FLOAT>, cell STRING, n INT")
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 0.95)
    for block in (1024, 7):
        got = near_vectors(frame, block_rows=block).collect()
        assert len(got) == len(rows)
        found = sorted(((r.id, r.n_links, r.component_id) for r in got), key=str)
        assert found == sorted(want, key=str)
        assert all(r.kept == (r.id is None or r.id == r.component_id) for r in got)


def test_nothing(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>")).count() == 0


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(12)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = np.array([around(rng, v, 0.9502, 1)[0] for v in a])
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([a, b]))]
    got = near_vectors(spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>")).filter("n_links > 0").count()
    assert got >= 0.97 * 3000


def test_components_are_reachability(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(200, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    pairs += [(2000, i) for i in range(2001, 2200)]
    frame = spark.createDataFrame(pairs, "a BIGINT, b BIGINT")
    got = {r.id: r.component for r in components(frame).collect()}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    assert got == {x: top(x) for x in parent}
    assert components(frame.filter(F.lit(False))).count() == 0
