"""Personal data against a plain reading of the forms, the bootstrap on planted contexts, and masks."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from feedloom.llm import pii
from feedloom.llm.common import cut_pieces, text_pieces

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fine(kind, value):
    digits = [int(c) for c in value if "0" <= c <= "9"]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def base(text):
    found = []
    for k, (kind, form) in enumerate(PLAIN.items()):
        found += [(m.start(), k, m.end()) for m in re.finditer(form, text or "") if fine(kind, m[0])]
    return sorted(found)


EDGES = [
    None, "", "   ", "a@b.c_d@e.f", "a@b.c@d.e.f", "x@y", "x@y..z", ".@a.b", "🛡️ a.b+c@x-y.co.uk, é", "1.2.3.4.5.6.7.8",
    "256.1.1.1 0.0.0.0 000.00.0.007 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 22",
    "+1 (017) 555-7713.", "+1 2", "+12345678901234567890", "++4930 1234567 ", "a@b.c" * 30, "1" * 3000, "9." * 900, "a" * 5000 + "@",
    "+1" + "-" * 3000 + "1", "x" * 30_000 + " me@here.org", "4111 1111 1111 1111\n+1 (017) 555-7713\n10.0.0.1 z@z.z", "a@b.c-", "a@b.-c",
    "1-1 1-1 1-1 1-1 1-1 1-1 1-1 1-1 1-1", "٣.٣.٣.٣", "a@b.c." * 2000,
]


@pytest.fixture(scope="module")
def texts(spark, sf):
    rng = random.Random(3)
    noise = ["".join(rng.choice("a1.@+- 9(é\n") for _ in range(rng.randint(1, 80))) for _ in range(800)]
    return EDGES + noise


def test_base_spans_are_the_plain_forms(spark, sf, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    real = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 100000 AS doc_id", "text")
    both = docs.union(real)
    by_id = {r.doc_id: r.text for r in both.collect()}
    for r in pii.find_personal(both).collect():
        assert [tuple(s) for s in r.base] == base(by_id[r.id]), by_id[r.id]


def test_query_columns(spark, sf):
    want = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = pii.op4_pii(spark, sf).collect()
    assert len(found) == len(want)
    for r in found:
        spans = base(want[r.doc_id])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, k, _ in spans) for x in range(4))
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))


def planted():
    rng = random.Random(9)
    rows = []
    for i in range(40):
        rows.append(f"please write to {'abcdefghij'[i % 10]}{i}@mail.example.com for help number {i}")
    rows += [f"please write to user{i}@internal for help" for i in range(3)]
    rows += [f"the year was 19{i}0000 or so" for i in range(10, 30)]
    rows += [f"order code X{rng.randint(100000, 999999)} was sent" for _ in range(20)]
    return rows


def test_bootstrap_finds_unseen_identifiers_in_trusted_contexts(spark):
    rows = planted()
    found = pii.find_personal(spark.createDataFrame(list(enumerate(rows)), "doc_id BIGINT, text STRING")).collect()
    extra = {rows[r.id][s.start : s.stop]: s.kind for r in found for s in r.extra}
    assert extra == {f"user{i}@internal": 0 for i in range(3)}


def test_bootstrap_is_the_plain_iteration(spark):
    rng = random.Random(4)
    seen = []
    for row in range(600):
        value = f"v{rng.randint(0, 60)}"
        kind = {0: 0, 1: 1}.get(int(value[1:]) % 3)
        for pattern in {f"p{rng.randint(0, 12)}", f"q{int(value[1:]) % 3}"}:
            seen.append((row, kind, 0, 5, value, pattern))
    seen += [(1000 + i, None, 0, 5, f"w{i}", p) for i in range(6) for p in ("q0", "q1")[: 1 + i % 2]]
    frame = spark.createDataFrame(seen, "row BIGINT, kind INT, start INT, stop INT, value STRING, pattern STRING")
    got = {tuple(r) for r in pii.bootstrap(frame, 3, 5, 0.6, 0.7).collect()}

    edges, kinds = {}, {}
    for _, kind, _, _, value, pattern in seen:
        edges.setdefault(pattern, set()).add(value)
        if kind is not None:
            kinds[value] = kind
    for _ in range(3):
        rules = {}
        for pattern, values in edges.items():
            for kind in (0, 1):
                support = sum(kinds.get(v) == kind for v in values)
                if support >= 5 and support / len(values) >= 0.6:
                    rules[pattern, kind] = support / len(values)
        fresh = {}
        for value in {v for vs in edges.values() for v in vs} - set(kinds):
            for kind in (0, 1):
                doubt = 1.0
                for (pattern, k), confidence in rules.items():
                    if k == kind and value in edges[pattern]:
                        doubt *= max(1 - confidence, 1e-9)
                if 1 - doubt >= 0.7 - 1e-12:
                    fresh[value] = min(fresh.get(value, (9, 9)), (doubt, kind))
        kinds |= {v: k for v, (_, k) in fresh.items()}
    want = {(r, kinds[v], a, b) for r, k, a, b, v, p in seen if k is None and v in kinds and (p, kinds[v]) in rules}
    assert got == want and got


def test_bootstrap_goes_on_until_nothing_is_added(spark):
    seen = [(i, 0 if i == 0 else None, 0, 5, f"v{i}", f"p{j}") for i in range(8) for j in (i - 1, i) if 0 <= j < 7]
    frame = spark.createDataFrame(seen, "row BIGINT, kind INT, start INT, stop INT, value STRING, pattern STRING")
    got = pii.bootstrap(frame, min_support=1, min_confidence=0.5, min_belief=0.4).collect()
    assert sorted(r.row for r in got) == list(range(1, 8))


def test_context_words_are_whole(spark):
    gap, word = " " * 60, "W" * 60
    texts = [
        f"please write to{gap}@{gap}for help", f"{word} {word}x @ {word}y z", f"a{' ' * 2000}b @ c", f"{'d' * 3000} e @{' ' * 2000}f",
        "@", "one @", "one two @ three", f"x{word}@{word} y", f"one\n{gap}\n@\n\nthree",
    ]
    frame = spark.createDataFrame([(t, t.index("@")) for t in texts], "t STRING, at INT")
    got = frame.select("t", pii._contexts(F.col("t"), text_pieces(F.col("t")), F.col("at"), F.col("at") + 1).alias("p")).collect()
    for r in got:
        before, after = (x.lower() for x in r.t.split("@"))
        words, following = before.split(), after.split()
        two = "before " + before[before.rindex(words[-2], 0, before.rindex(words[-1])) :].rstrip() if len(words) > 1 else None
        assert r.p == [two, f"around {words[-1]} _ {following[0]}" if words and following else None]


def test_masks(spark):
    rows = [
        (1, "mail a@b.co or 10.0.0.1!", 5, "k"), (2, None, None, None), (None, "+1 (017) 555-7713", 17, "k"),
        (3, "🛡️ 4111 1111 1111 1111 é", 23, None), (3, "1.1.1.1@a.bc", 1, "k"), (4, "", 0, ""),
    ] + [(100 + i, t, 0, "x") for i, t in enumerate(planted())]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, n_chars BIGINT, base STRING")
    found = pii.mask_personal(docs)
    assert found.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.base) for r in found.collect()), key=str)
    texts = {t for _, t, _ in got}
    assert {"mail <EMAIL> or <IP>!", "<PHONE>", "🛡️ <CARD> é", "<EMAIL>", ""} <= texts
    assert "please write to <EMAIL> for help" in texts and not any("@" in t for t in texts)
    assert len(got) == len(rows)
    assert pii.mask_personal(docs.limit(0)).count() == 0
    assert F.col is not None


def test_pieces_of_a_text(spark):
    rng = random.Random(7)
    for n in (0, 1, 1023, 1024, 1025, 70_000):
        text = "".join(rng.choices("aé中\U0001f600 ", k=n))
        spots = [(a, b) for a in (0, 1, 1000, 1024, n // 2, max(n - 3, 0)) for b in (a, a + 1, a + 30, a + 1024, n) if b >= a]
        rows = spark.createDataFrame([(text, a, b) for a, b in spots], "t STRING, a INT, b INT")
        pieces = text_pieces(F.col("t"))
        found = rows.select("t", "a", "b", F.array_join(pieces, "").alias("w"), cut_pieces(pieces, F.col("a"), F.col("b")).alias("c"))
        for r in found.collect():
            assert r.w == r.t and r.c == r.t[r.a : r.b]


def test_loose_hits_that_overlap_no_span(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(200):
        at, loose = 0, []
        for _ in range(rng.randint(0, 8)):
            at += rng.randint(0, 4)
            loose.append((at, at + rng.randint(1, 5), f"v{at}"))
            at = loose[-1][1]
        base = sorted((s, 0, s + rng.randint(1, 9), "b") for s in (rng.randint(0, 40) for _ in range(rng.randint(0, 5))))
        rows.append((loose, base))
    kind = "loose array<struct<start:int,stop:int,value:string>>, base array<struct<start:int,kind:int,stop:int,value:string>>"
    frame = spark.createDataFrame(rows, kind)
    for r in frame.withColumn("free", pii.free_of(F.col("loose"), F.col("base"))).collect():
        want = [h for h in r.loose if not any(b.start < h.stop and h.start < b.stop for b in r.base)]
        assert r.free == want


def test_work_is_linear_in_the_matches(spark):
    """20,000 numbers in one text; before, a fifth of them took half a minute."""
    n = 20_000
    text = " ".join(f"10.0.{i % 250}.{i % 7}" if i % 2 else f"{100000 + i}" for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id BIGINT, text STRING")
    r = pii.find_personal(docs).collect()[0]
    assert len(r.base) == n // 2
    assert all(text[s.start : s.stop].startswith("10.0.") for s in r.base[::997])
    masked = pii.mask_personal(docs).collect()[0].text
    assert masked.count("<IP>") == n // 2 and masked.startswith("100000 <IP> 100002 <IP>")
