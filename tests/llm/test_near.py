"""BagMinHash estimates and near-duplicate groups against brute force."""

import collections
import random

import numpy as np

from feedloom.llm import bagminhash as bmh
from feedloom.llm.near_dedup import drop_near_duplicates, near_duplicates


def plain_bag(text, size=5):
    words = (text or "").lower().translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    words = [w for w in words if w]
    if not words:
        return collections.Counter()
    width = min(size, len(words))
    return collections.Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def plain_overlap(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0


def test_shingles_are_the_plain_bag():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "É", "c ", " ", "\n", "\t", "dd "]) for _ in range(rng.randint(0, 200)))
        keys, counts = bmh.shingles(text)
        assert sorted(counts.tolist()) == sorted(plain_bag(text).values())
        other = text.replace("a", "x", 2)
        assert np.isclose(bmh.overlap((keys, counts), bmh.shingles(other)), plain_overlap(plain_bag(text), plain_bag(other)))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    m = 4096
    for top in (1, 3, 40, 1000):
        keys = bmh.mix(np.arange(60, dtype=np.uint64) + np.uint64(top))
        a = rng.integers(1, top + 1, size=60)
        b = np.where(rng.random(60) < 0.6, a, rng.integers(0, top + 1, size=60))
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        got = (bmh.signature(keys, a, m) == bmh.signature(keys[b > 0], b[b > 0], m)).mean()
        assert abs(got - want) < 5 * np.sqrt(want * (1 - want) / m) + 0.005, (top, got, want)


def test_signature_of_one_element_and_of_its_repeats():
    key = np.array([7], dtype=np.uint64)
    one, same = bmh.signature(key, np.array([1]), 180), bmh.signature(key, np.array([1]), 180)
    assert (one == same).all() and (one != 0).all()
    assert abs((bmh.signature(key, np.array([2]), 4096) == bmh.signature(key, np.array([1]), 4096)).mean() - 0.5) < 0.05


def edited(rng, words, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


VOCABULARY = [f"w{i}" for i in range(4000)]


def corpus():
    rng = random.Random(7)
    rows, n = [], 0

    def add(words):
        nonlocal n
        rows.append((n * 7 % 1009, " ".join(words), "x"))
        n += 1

    for _ in range(60):
        add(rng.choices(VOCABULARY, k=rng.randint(3, 200)))
    for share in (0.0, 0.005, 0.01, 0.02, 0.04, 0.1):
        for _ in range(4):
            text = rng.choices(VOCABULARY, k=120)
            for _ in range(6):
                add(edited(rng, text, share))
    passage = rng.choices(VOCABULARY, k=60)
    for _ in range(30):
        add(rng.choices(VOCABULARY, k=25) + passage + rng.choices(VOCABULARY, k=25))
    loop = rng.choices(VOCABULARY, k=8)
    for k in (3, 20, 24, 25, 40):
        add(loop * k)
    rows.extend([(5000, None, "x"), (5001, "", "x"), (5002, " \n", "x"), (5003, "one two", "x"), (5004, "One  TWO\n", "x"),
                 (None, "one two", "x"), rows[0], rows[0], (5005, rows[1][1].upper(), None)])
    return rows


def brute(rows):
    bags = [plain_bag(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if plain_overlap(bags[i], bags[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(i)
    return list(groups.values())


def test_groups_are_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, place STRING")
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    want = []
    for members in brute(rows):
        head = min(members, key=order)
        want += [(rows[i][0], rows[head][0], len(members)) for i in members]
    found = near_duplicates(frame).collect()
    assert sorted(((r.id, r.group_id, r.group_size) for r in found), key=str) == sorted(want, key=str)
    kept = drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    left = sorted((r.doc_id for r in kept.collect()), key=str)
    assert left == sorted((min((rows[i][0] for i in g), key=lambda x: (x is None, x or 0)) for g in brute(rows)), key=str)
    assert sum(r.kept for r in found) == len(left)


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty).count() == 0


def test_pairs_of_unlike_signatures_are_decided(spark):
    # Signatures of ten components agree by chance in far fewer than eight for many pairs that overlap by 0.8.
    rng, rows = random.Random(11), []
    for _ in range(40):
        text = rng.choices(VOCABULARY, k=120)
        rows += [" ".join(edited(rng, text, 0.018)) for _ in range(8)]
    bags = [bmh.shingles(t) for t in rows]
    signatures = np.array([bmh.signature(*b, 10) for b in bags])
    parent = list(range(len(rows)))

    def top(i):
        return i if parent[i] == i else top(parent[i])

    for i in range(len(rows)):
        for j in np.flatnonzero((signatures[:i] == signatures[i]).any(axis=1)):
            if bmh.overlap(bags[i], bags[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    found = near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id BIGINT, text STRING"), bands=10, band_rows=1)
    assert {r.id: r.group_id for r in found.collect()} == {i: top(i) for i in range(len(rows))}
