"""Exact dedup, line dedup and sharding against brute force, and their edge rows."""

import collections
import hashlib
import re
import struct
import zlib

import xxhash
from pyspark.sql import functions as F

from feedloom.llm.exact_dedup import exact_dedup
from feedloom.llm.line_dedup import drop_common_lines
from feedloom.llm.shards import SEED, shard_rows, write_shards

LONG = "word " * 40_000
ROWS = [
    (1, "a b\tc", "x"), (2, "abc", None), (3, "a  b c", "x"), (4, None, "x"), (5, "", "y"), (6, " \n", "y"),
    (7, "É\nabc", "z"), (8, "É\nabc", "z"), (8, "É\nabc", "z"), (None, "É\nabc", "z"), (None, "abc", None),
    (9, LONG, "x"), (10, LONG + "!", "x"), (11, "a\x0bbc\x0c", "x"), (12, "a bc", "x"),
]
SCHEMA = "doc_id BIGINT, text STRING, keep STRING"


def frame(spark, rows=ROWS, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup_is_brute_force(spark):
    groups = collections.defaultdict(list)
    for i, text, _ in ROWS:
        groups[normal(text)].append((-len(text or ""), i is None, i or 0))
    found = exact_dedup(frame(spark)).collect()
    assert len(found) == len(ROWS)
    by_sum = {hashlib.sha256(k.encode()).hexdigest(): sorted(v) for k, v in groups.items()}
    kept = collections.Counter()
    for r in found:
        group = by_sum[r.full]
        assert r.group_size == len(group)
        assert r.keep_id == (None if group[0][1] else group[0][2])
        assert not r.kept or r.id == r.keep_id
        kept[r.full] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(frame(spark, [])).count() == 0


def test_full_hashes_are_compared_only_where_length_and_prefix_agree(spark, monkeypatch):
    from feedloom.llm import exact_dedup as module

    head = "x" * module.PREFIX
    texts = ["a b", "ab", "cd", "abc", head + "1", head + "2", head + "12", "é"]
    prints = module.fingerprints(frame(spark, [(i, t, None) for i, t in enumerate(texts)])).cache()
    assert sorted(r.id for r in module.narrowed(prints).collect()) == [0, 1, 4, 5]
    assert [r.group_size for r in module.equal_groups(prints).collect()] == [2]
    monkeypatch.setattr(module, "narrowed", lambda rows: rows.limit(0))
    assert module.equal_groups(prints).count() == 0


def clean_lines(texts, least):
    key = lambda line: "".join(
        c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r")
    )
    split = [(t or "").split("\n") for t in texts]
    seen = collections.Counter(k for lines in split for k in {key(x) for x in lines} if k)
    return [[x for x in lines if not key(x) or seen[key(x)] < least] for lines in split], split


def test_line_dedup_is_brute_force(spark):
    texts = [
        "Same line\nown 1", " same LINE \nown 2\nsame line", "same line\t\n\nown 3", "ÉCOLE\nown 4",
        "École\nown 5", "éCOLE\nown 6", "ÉCOLE \nown 7", None, "", "\n\n", "Ⅰ a\nİ", "Ⅰ a\nⅰ a", "ⅰ A\nx", "ⅰ A",
        "same line\n" * 3000 + "end",
    ]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(None, "Same line\nnull id", "k")]
    for least in (2, 3, 4):
        want, split = clean_lines([r[1] for r in rows], least)
        found = drop_common_lines(frame(spark, rows, "doc_id BIGINT, text STRING, N_Lines STRING"), min_docs=least)
        assert found.columns == ["doc_id", "text", "n_lines", "n_dropped"]
        got = {r.doc_id: r for r in found.collect()}
        assert len(got) == len(rows)
        for (i, _, _), kept, lines in zip(rows, want, split):
            assert got[i].text == "\n".join(kept)
            assert (got[i].n_lines, got[i].n_dropped) == (len(lines), len(lines) - len(kept))
    assert drop_common_lines(frame(spark, [])).count() == 0


def test_lines_of_repeated_ids_count_once(spark):
    rows = [(i, "five documents\nown", "k") for i in range(5)] * 2
    rows += [(None, "no id", "k")] * 10 + [(i, "ten documents", "k") for i in range(20, 30)] + [(30, f"one\n{i}", "k") for i in range(12)]
    got = collections.Counter(r.text for r in drop_common_lines(frame(spark, rows)).collect())
    assert got["five documents\nown"] == 10 and got[""] == 20
    assert sum(n for text, n in got.items() if text.startswith("one\n")) == 12


def xx(*parts):
    """Spark's xxhash64 of strings, integers (INT or BIGINT) and nulls."""
    seed = 42
    for kind, value in parts:
        if value is None:
            continue
        raw = value.encode() if kind == "s" else struct.pack({"i": "<i", "l": "<q"}[kind], value)
        seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def brute_shards(rows, shards):
    def shard(key, n):
        return max((xx(("i", SEED + i), ("l", key)), i) for i in range(n))[1]

    groups = collections.defaultdict(list)
    for i, text, _ in rows:
        raw = (text or "").encode()
        groups[shard(i, shards)].append((i, zlib.crc32(raw), len(raw) + 8))
    out = []
    for s, items in groups.items():
        items.sort(key=lambda x: (x[0] is not None, x))
        salt = xx(("i", SEED), ("i", s), ("l", 0))
        for i in range(len(items) - 1, 0, -1):
            j = xx(("l", salt), ("i", i)) % (i + 1)
            items[i], items[j] = items[j], items[i]
        out += [(i, size, crc, s, slot, shard(i, shards + 1)) for slot, (i, crc, size) in enumerate(items)]
    return sorted(out, key=str)


def test_shards_are_brute_force(spark):
    rows = ROWS[:-4] + [(100 + i, f"text {i}", "x") for i in range(300)]
    got = shard_rows(frame(spark, rows), ["doc_id"], shards=5).collect()
    got = sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.grown_shard) for r in got), key=str)
    assert got == brute_shards(rows, 5)


def test_shards_have_gapless_slots_over_many_buckets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("Shard", F.lit("clash"))
    from feedloom.llm import shards as module

    rows = docs.select("doc_id", F.octet_length("text").cast("long").alias("size"), F.crc32("text").alias("text_crc32"))
    many = module.scatter(rows, "doc_id", 3, bucket_rows=10)
    assert many.select("bucket").distinct().count() > 3
    placed = module.shuffle_buckets(many, ["doc_id", "size"]).collect()
    by = collections.defaultdict(list)
    for r in placed:
        by[r.shard].append(r.slot)
    assert len(placed) == docs.count()
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = module.shuffle_buckets(many.repartition(3), ["doc_id", "size"]).collect()
    assert sorted(map(tuple, placed)) == sorted(map(tuple, again))


def test_shards_keep_whole_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    write_shards(frame(spark), path, shards=4)
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select("doc_id", "text", "keep").collect())) == sorted(
        map(str, frame(spark).collect())
    )
    assert shard_rows(frame(spark, []), ["doc_id"]).count() == 0
