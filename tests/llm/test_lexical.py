"""Ranked search against scores of every document, counted one by one."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    """(item row, doc_id, score, rank) of the best documents, every one scored."""
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag, n in bags:
            m = 75 + 25 * n * n_docs // total
            score = 0
            for t, times in Counter(terms_of(text)).items():
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, i, -s, rank) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found_by(spark, docs, items, k, **more):
    d = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    q = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    rows = lexical.search(d.repartition(3), q, k, **more).collect()
    return sorted(((r.item_id, r.doc_id, r.score, r["rank"]) for r in rows), key=str)


def made(rng, n, words):
    """Texts of skewed words, some repeated, some long."""
    pool = [f"w{i}" for i in range(words)]
    shares = [1 / (i + 1) for i in range(words)]
    texts = [" ".join(rng.choices(pool, shares, k=rng.choice([1, 3, 8, 30, 200]))) for _ in range(n)]
    return texts + rng.choices(texts, k=n // 5)


@pytest.mark.parametrize("seed", [1, 2])
def test_best_documents_are_those_of_a_full_count(spark, seed, monkeypatch):
    rng = random.Random(seed)
    docs = list(enumerate(made(rng, 300, 60)))
    items = list(enumerate(made(rng, 20, 80)))
    want = plain(docs, items, 5)
    assert found_by(spark, docs, items, 5) == want
    # Several blocks of items.
    assert found_by(spark, docs, items, 5, block_bytes=900) == want


def test_few_accumulators_are_made_and_nothing_is_lost():
    rng = random.Random(3)
    texts = made(rng, 2000, 300)
    bags = [Counter(terms_of(t)) for t in texts]
    vocabulary = {t: i for i, t in enumerate(sorted({t for b in bags for t in b}))}
    n = np.array([sum(b.values()) for b in bags])
    ids = np.array([vocabulary[t] for b in bags for t in sorted(b)])
    times = np.array([b[t] for b in bags for t in sorted(b)])
    sizes = np.array([len(b) for b in bags])
    df = Counter(ids.tolist())
    limited = 0
    for size in (len(bags), 500, 37):
        items = [sorted(rng.sample(sorted(df), 12), key=lambda i: (df[i], i)) for _ in range(15)]
        asked = [lexical.Item(i, x, [lexical.term_weight(len(bags), df[t]) for t in x]) for i, x in enumerate(items)]
        best = {i: [] for i in range(15)}
        whole = lexical.Segment(n, sizes, ids, times, len(bags), int(n.sum()))
        starts = np.append(0, np.cumsum(sizes))
        for lo in range(0, len(bags), size):
            hi = min(lo + size, len(bags))
            part = slice(starts[lo], starts[hi])
            segment = lexical.Segment(n[lo:hi], sizes[lo:hi], ids[part], times[part], len(bags), int(n.sum()))
            for item in asked:
                known = best[item.key]
                places, scores = segment.search(item, 10, known[-1][0] * -1 if len(known) == 10 else 0)
                best[item.key] = sorted([*known, *zip((-scores).tolist(), (places + lo).tolist())])[:10]
                assert not segment.scores.any()
                limited += len(places) < np.isin(ids[part], item.ids).sum()
        for item in asked:
            scores = np.zeros(len(bags), dtype=np.int64)
            for i, w in zip(item.ids, item.weights):
                at = np.searchsorted(whole.terms, i)
                lists = slice(whole.ends[at], whole.ends[at + 1])
                scores[whole.places[lists]] += whole.parts[lists] * w
            every = sorted((-s, i) for i, s in enumerate(scores.tolist()) if s > 0)
            assert best[item.key] == every[:10]
    assert limited


def test_no_new_accumulators_once_the_bound_is_low():
    # One rare term in three documents, one common in all: with k = 2 the common one makes no accumulator.
    n = np.full(100, 10)
    ids = np.array([0, 1] * 3 + [1] * 97)
    sizes = np.array([2] * 3 + [1] * 97)
    segment = lexical.Segment(n, sizes, ids, np.ones(103, dtype=np.int64), 100, 1000)
    item = lexical.Item(0, [0, 1], [lexical.term_weight(100, 3), lexical.term_weight(100, 100)])
    places, scores = segment.search(item, 2, 0)
    assert places.tolist() == [0, 1, 2] and len(set(scores.tolist())) == 1
    assert scores[0] == segment.most[0] * item.weights[0] + segment.most[1] * item.weights[1]


def test_edge_rows(spark):
    docs = [
        (1, "Alpha beta"), (2, "alpha BETA"), (3, None), (4, ""), (5, "!? -"), (None, "alpha beta"), (1, "Alpha beta"),
        (6, "Äpfel äpfel 42x"), (7, "beta " * 300_000 + "gamma"),
    ]
    items = [(1, "alpha"), (2, None), (3, ""), (None, "beta beta"), (4, "ÄPFEL Äpfel 42X"), (1, "gamma nothing"), (5, "unknown")]
    assert found_by(spark, docs, items, 4) == plain(docs, items, 4)
    assert found_by(spark, docs, items[:0], 4) == [] and found_by(spark, docs[:0], items, 4) == []
    d = spark.createDataFrame([("a", "x y", 1, 2)], "doc_id STRING, text STRING, item INT, score INT")
    q = spark.createDataFrame([("q", "y", 1)], "item_id STRING, text STRING, doc INT")
    assert [tuple(r)[:3] for r in lexical.search(d, q).collect()] == [("q", 1, "a")]


def test_long_texts_in_pieces():
    from feedloom.llm import terms

    rng = random.Random(8)
    text = " ".join("x" * rng.randint(1, 40) + rng.choice(["A", "é", "7"]) for _ in range(500)).encode()
    want = text.translate(terms.LETTERS).split()
    for piece in (1, 5, 64, 10**6):
        assert [t for part in terms.term_lists(text, terms.LETTERS, piece) for t in part] == want
    assert list(terms.term_lists(None, terms.LETTERS)) == list(terms.term_lists(b"", terms.LETTERS)) == []
