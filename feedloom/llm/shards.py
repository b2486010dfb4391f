"""Sharding by a two-pass external shuffle: scatter into buckets, then shuffle each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import seeded, whole_text

#: Production parameters: shards, seed, and what a bucket may hold on average.
SHARDS = 24
SEED = 20240601
BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 1024


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the highest hash for this key; with one more shard, rows move only there."""
    scores = [
        F.struct(seeded(seed + i, key).alias("score"), F.lit(i).alias("shard")) for i in range(shards)
    ]
    return F.array_max(F.array(*scores))["shard"]


def _fisher_yates(items: Column, salt: Column) -> Column:
    """The array in the order of a Fisher-Yates shuffle whose draws are seeded hashes.

    From the last place down, each place swaps with a drawn place at or below it.
    """

    def swap(order: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(salt, i), i + 1).cast("int")
        low = F.get(order, j)
        moved = F.concat(
            F.slice(order, F.lit(1), j),
            F.array(F.get(order, i)),
            F.slice(order, j + 2, i - j - 1),
            F.array(low),
            F.slice(order, i + 2, F.size(order)),
        )
        return F.when(i == j, order).otherwise(moved)

    last = F.size(items) - 1
    downward = F.when(last > 0, F.sequence(last, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    order = F.aggregate(downward, F.sequence(F.lit(0), last), swap)
    return F.transform(order, lambda i: F.get(items, i))


def scatter(
    rows: DataFrame, key: str, shards: int = SHARDS, seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """First pass: `rows` (with `size` and `text_crc32`) with shard and bucket.

    The key decides the shard. Within a shard a seeded hash of key and content deals rows
    uniformly into as many buckets as memory-sized ones need; one pass over the sizes finds how
    many. Rows of one key, null keys too, differ in content and so part again; only rows that
    agree in everything share a bucket.
    """
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    need = max((total["n"] or 0) / bucket_rows, (total["bytes"] or 0) / bucket_bytes)
    buckets = max(1, -int(-need // shards))
    return rows.withColumns(
        {
            "shard": shard_of(F.col(key), shards, seed),
            "bucket": F.pmod(seeded(seed, F.col(key), F.col("text_crc32"), F.col("size")), F.lit(buckets)),
        }
    )


def shuffle_buckets(scattered: DataFrame, columns: list[str], seed: int = SEED) -> DataFrame:
    """Second pass: each bucket in a Fisher-Yates order; `slot` counts on through the shard.

    A bucket is sorted before it is shuffled, so a repeated run or task gives the same order.
    """
    gathered = scattered.groupBy("shard", "bucket").agg(
        F.array_sort(F.collect_list(F.struct(*columns))).alias("items")
    )
    sizes = scattered.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    # The window reads one row per bucket, not per record.
    upto = F.sum("n").over(_by_shard())
    offsets = sizes.select("shard", "bucket", (upto - F.col("n")).alias("offset"))
    salt = F.xxhash64(F.lit(seed), "shard", "bucket")
    dealt = gathered.join(offsets, ["shard", "bucket"]).select(
        "shard", "offset", F.posexplode(_fisher_yates(F.col("items"), salt)).alias("pos", "item")
    )
    return dealt.select("item.*", "shard", (F.col("offset") + F.col("pos")).alias("slot"))


def _by_shard():
    from pyspark.sql import Window

    return Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)


def shard_rows(
    docs: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text",
    shards: int = SHARDS, seed: int = SEED,
) -> DataFrame:
    """`columns` of each row with size, text_crc32, shard, slot and grown_shard.

    Law `key`: id and number of shards alone decide the shard; all rows with a null id share one.
    `grown_shard` is the shard with one more shard. Size is the UTF-8 bytes of the text (null:
    none) plus eight. Slots of a shard run from 0 without gaps, in shuffled order. Empty input
    gives no rows. Name `text_col` among `columns` to move the texts as well.
    """
    text = whole_text(text_col)
    extra = [c for c in columns if c not in ("size", "text_crc32", "shard", "slot", "grown_shard")]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in extra],
        F.col(id_col).alias("_key"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = shuffle_buckets(scatter(rows, "_key", shards, seed), ["_key", "text_crc32", "size", *extra], seed)
    grown = shard_of(F.col("_key"), shards + 1, seed)
    return placed.select(*extra, "size", "text_crc32", "shard", "slot", grown.alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write whole rows as Parquet, a folder per shard, in slot order within each file."""
    placed = shard_rows(docs, docs.columns, **options)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by law `key`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = shard_rows(docs, ["doc_id"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), "grown_shard",
    )
