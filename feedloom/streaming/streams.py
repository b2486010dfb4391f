"""The digest steps on streams, run over what is there and then stopped, or kept running.

Feeds are read twice a day and hold items of any age, so publish times say nothing about how far a
stream has come. Watermarks go by arrival, and hourly counts are kept as sums that any later row
can still add to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.lines import extract_bullets, normalize_bullets
from feedloom.functions.text import no_strings
from feedloom.operators.commits import folder_at
from feedloom.operators.posts import unprocessed_posts, with_keys
from feedloom.operators.state import ProcessedPosts, to_state_rows
from feedloom.session import settle
from feedloom.sources.feeds import clean_items, items_or_rejects, items_to_feeds, parse_feeds


#: Keeps more keys than fit in memory; only what a batch changes goes to the checkpoint.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def payload_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Payload files as they arrive."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_ingest(payloads: DataFrame) -> DataFrame:
    """Payloads to clean items, row by row."""
    return clean_items(parse_feeds(payloads))


def stream_outcomes(payloads: DataFrame) -> DataFrame:
    """Payloads to clean items and rejects, row by row: `kind` is `item` or `reject`, with a `reason`.

    Every payload has a row. A reject is a payload that failed, is no feed or has no items, or an item without a readable
    date. Written by `kind`, both sides come from one pass over the payloads and one commit per batch.
    """
    return items_or_rejects(payloads)


def stream_dedup(
    posts: DataFrame, known: DataFrame | None = None, delay: str | None = None, arrival: str = "fetched_at"
) -> DataFrame:
    """The first sighting of each (pk, rk), however long ago.

    Keys are kept as state of the stream and never expire, as they never do in the state table; a restart goes on with
    them. `known`: keys (pk, rk) handled before the stream began, such as a settled copy of the keys of the state
    table; it must stay the same from start to start, or a replayed batch would lose its own rows. With
    `delay` keys are kept for that long behind the newest arrival only, and the state table has to catch older repeats.
    """
    keyed = with_keys(posts)
    if known is not None:
        keyed = keyed.join(known.select("pk", "rk"), ["pk", "rk"], "left_anti")
    if delay is not None:
        return keyed.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(["pk", "rk"])
    return keyed.dropDuplicates(["pk", "rk"])


def on_disk_state(spark: SparkSession) -> None:
    """Let streams that start from now on keep their state on local disk and in the checkpoint, not in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def upsert_batch(state: ProcessedPosts, writer: str) -> Callable[[DataFrame, int], None]:
    """Sink of a stream of state rows: one version per batch, the same one on a replay.

    The state table keeps the newest row per key of what it is given.
    `writer` names the stream together with its checkpoint; a new checkpoint needs a new name.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        state.append(batch, batch_id, writer)

    return write


def items_to_state(state: ProcessedPosts, feeds: DataFrame, writer: str) -> Callable[[DataFrame, int], None]:
    """Sink of a stream of clean items: feed join, check against the state, upsert of the new ones.

    A post is handled when it arrived. A replayed batch writes the version it wrote before, so its
    own rows must not count as handled: the check reads the state without them.
    """
    write = upsert_batch(state, writer)

    def run(batch: DataFrame, batch_id: int) -> None:
        posts = items_to_feeds(batch, feeds).filter("published IS NOT NULL")
        bullets = normalize_bullets(extract_bullets(F.col("summary")))
        ready = posts.withColumns({"english_summary": bullets, "korean_summary": no_strings()})
        # Settled, so Spark knows their size: below the broadcast limit they are sent to the posts, whose texts stay.
        seen = settle(state.seen(ready, but=(writer, batch_id)), "seen")
        fresh = unprocessed_posts(ready, seen)
        write(to_state_rows(fresh, F.col("fetched_at")), batch_id)

    return run


def hourly_status(items: DataFrame) -> DataFrame:
    """Items per hour and feed, of one batch."""
    return items.groupBy(F.date_trunc("hour", "published").alias("hour"), "feed_id").agg(
        F.count(F.lit(1)).alias("items")
    )


def status_windows(hours: DataFrame) -> DataFrame:
    """Items per feed over 24 hours, each hour, from hourly sums."""
    starts = F.explode(F.sequence(F.lit(0), F.lit(23)))
    moved = hours.withColumn("_k", starts).withColumn(
        "start", F.col("hour") - F.make_dt_interval(hours=F.col("_k"))
    )
    return moved.groupBy("start", "feed_id").agg(F.sum("items").alias("items"))


def hourly_latency(requests: DataFrame) -> DataFrame:
    """Sum, maximum and count per hour and name, of one batch."""
    return requests.groupBy(F.date_trunc("hour", "ts").alias("hour"), "name").agg(
        F.sum(F.col("duration").cast("decimal(20,6)")).alias("total"),
        F.max("duration").alias("max_duration"),
        F.count("duration").alias("given"),
        F.count(F.lit(1)).alias("n"),
    )


def latency(hours: DataFrame) -> DataFrame:
    """Average and maximum duration and count per hour and name."""
    mean = F.col("total").cast("double") / F.col("given")
    return hours.select("hour", "name", mean.alias("avg_duration"), "max_duration", "n")


def run_append(stream: DataFrame, path: str, checkpoint: str, by: str | None = None) -> None:
    """Write finished rows to Parquet, in folders by column `by` if given, until the input at hand is used up."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer = writer.partitionBy(by) if by else writer
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand each batch to `write` until the input at hand is used up."""
    writer = stream.writeStream.foreachBatch(write).outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


#: Batches that are put together to one, and so on with what they make.
FAN = 8


class StreamedSums:
    """Sums of a stream in a folder: `from=F/to=T` holds those of the batches F to T.

    Every batch writes its own sums. Each `FAN`th one also puts the last `FAN` together, each `FAN` squared-th those
    of the next tier, and so on, so a reader finds few folders however long the stream runs. What a finished
    folder covers is the mark of how far sums are committed: a replayed batch that lies in one is not counted again.
    Which folders are put together follows from the batch number alone, so a replay after a crash does the same again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], largest: tuple[str, ...] = (), fan: int = FAN):
        """Sums per `keys`; columns in `largest` are maxima instead."""
        self.spark, self.path, self.keys, self.largest, self.fan = spark, path.rstrip("/"), keys, largest, fan

    def sink(self, summed: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        def write(batch: DataFrame, batch_id: int) -> None:
            done = self._written()
            if any(lo <= batch_id <= hi and hi > lo for lo, hi in done):
                return
            # Batches before this one will not come again, so what their sums were put together to stands.
            self._drop([r for r in done if r not in self._largest(done)])
            summed(batch).write.mode("overwrite").parquet(self._folder(batch_id, batch_id))
            size = self.fan
            while (batch_id + 1) % size == 0:
                self._fold(batch_id + 1 - size, batch_id)
                size *= self.fan

        return write

    def read(self) -> DataFrame:
        """The sums of all batches per key."""
        return self._summed(self._largest(self._written()))

    def hand_over(self, into: StreamedSums) -> None:
        """Write the sums so far as those before the first batch of a stream that begins anew."""
        self.read().write.mode("overwrite").parquet(into._folder(-1, -1))

    def _fold(self, first: int, last: int) -> None:
        parts = [r for r in self._largest(self._written()) if first <= r[0] and r[1] <= last]
        if len(parts) > 1:
            self._summed(parts).write.mode("overwrite").parquet(self._folder(first, last))

    def _summed(self, parts: list[tuple[int, int]]) -> DataFrame:
        rows = self.spark.read.parquet(*[self._folder(lo, hi) for lo, hi in parts])
        values = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(*[(F.max(c) if c in self.largest else F.sum(c)).alias(c) for c in values])

    def _folder(self, first: int, last: int) -> str:
        return f"{self.path}/from={first}/to={last}"

    def _written(self) -> list[tuple[int, int]]:
        """First and last batch of each folder that was written to the end."""
        path, files = folder_at(self.spark, f"{self.path}/from=*/to=*/_SUCCESS")
        names = [str(f.getPath().getParent()).split("/")[-2:] for f in files.globStatus(path) or []]
        return sorted((int(lo.removeprefix("from=")), int(hi.removeprefix("to="))) for lo, hi in names)

    @staticmethod
    def _largest(done: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Folders that lie in no other one."""
        return [r for r in done if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in done)]

    def _drop(self, parts: list[tuple[int, int]]) -> None:
        for lo, hi in parts:
            path, files = folder_at(self.spark, self._folder(lo, hi))
            files.delete(path, True)
