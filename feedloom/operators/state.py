"""Table of processed posts, one row per (pk, rk).

New rows are appended as versions, each writer counting its own; a full snapshot is written now
and then. Adding thirty posts therefore never rewrites the table, and a version written twice stays
the same.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom import schemas
from feedloom.functions.dates import ago
from feedloom.functions.keys import source_emoji
from feedloom.functions.text import no_strings
from feedloom.operators.commits import CommitLog, Entry, Versions, covers, folder_at, with_versions
from feedloom.operators.filters import required_fields
from feedloom.operators.posts import with_keys
from feedloom.session import settle

_COLUMNS = [part.split()[0] for part in schemas.PROCESSED.split(", ")]


def latest_per_key(rows: DataFrame, *order: Column) -> DataFrame:
    """One row per (pk, rk), the first by `order`."""
    w = Window.partitionBy("pk", "rk").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def state_keys(processed: DataFrame) -> DataFrame:
    """Keys only: two columns are read and no row is resolved."""
    return processed.select("pk", "rk").distinct()


def to_state_rows(posts: DataFrame, as_of: Column) -> DataFrame:
    """Posts as state rows; bullet arrays become JSON text."""
    good, _ = required_fields(posts)
    return with_keys(good).select(
        "pk",
        "rk",
        "title",
        "link",
        "source_name",
        "summary",
        F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publish_date"),
        F.to_json(F.coalesce("english_summary", no_strings())).alias("english_summary"),
        F.to_json(F.coalesce("korean_summary", no_strings())).alias("korean_summary"),
        as_of.alias("processed_date"),
        as_of.alias("ts"),
    )


def upsert_processed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows with the rows of `new` inserted, or put in place of those with the same key.

    Only the keys of `new` meet the old rows, so the old table is not shuffled while `new`
    is small enough for Spark to broadcast its keys.
    """
    last = latest_per_key(new, F.col("processed_date").desc(), F.col("link"), F.col("title"))
    kept = old.join(last.select("pk", "rk"), ["pk", "rk"], "left_anti")
    return kept.select(*old.columns).unionByName(last.select(*old.columns))


#: Buckets that keys are dealt to by `rk`. Fixed for all tables, as it is part of their layout.
BUCKETS = 256


def key_bucket(rk: Column) -> Column:
    return F.pmod(F.xxhash64(rk), F.lit(BUCKETS)).cast("int")


#: Rows of a file that share a bitmap, as many as one of Spark's bitmaps holds.
_BITS = 32768


def _dated(rows: DataFrame) -> DataFrame:
    """State rows with the day that they are stored under."""
    return rows.select(*_COLUMNS).withColumn("day", F.to_date("ts"))


@dataclass
class _Parts:
    """What is committed: the newest snapshot, versions after it with their turns, and what is folded."""

    snapshot: Entry | None
    open: dict[tuple[str, int], tuple[int, str]]
    folded: Versions

    def turns(self, but: tuple[str, int] | None = None, snapshot: bool = True) -> dict[str, int]:
        """Turn of each folder that counts; a snapshot comes before all that it does not hold."""
        out = {self.snapshot["folder"]: -1} if self.snapshot and snapshot else {}
        return out | {folder: turn for key, (turn, folder) in self.open.items() if key != but}


class ProcessedPosts:
    """The state table in a folder: `rows/commit=C/day=D`, `keys/commit=C/bucket=B` and `commits`.

    Rows lie by the day they were stored, keys by a hash of `rk`: recent posts read their days and a
    duplicate check the buckets of its posts. Nothing counts before it is committed. Every writer (a batch
    job, one stream with its checkpoint) counts its own versions, in any order. A commit takes
    the next free turn, and of two rows with one key the one of the later turn wins; a version that is written
    again keeps its first turn. A snapshot holds the table up to a turn and the set of versions it has taken in.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/commits")

    def append(self, rows: DataFrame, version: int, writer: str = "batch") -> None:
        """Write one version of a writer; writing it again replaces it, or does nothing once it is folded.

        A stream with a new checkpoint counts from 0 again and must come as a new writer.
        """
        if covers(self._parts().folded, writer, version):
            return
        order = (F.col("processed_date").desc(), F.col("link"), F.col("title"), F.col("publish_date"), F.col("ts"))
        folder = self._write(_dated(latest_per_key(rows, *order)))
        self.log.add({"kind": "append", "writer": writer, "version": version, "folder": folder})

    def snapshot(self) -> None:
        """Fold all that is committed so far into one copy that later reads start from.

        Versions that are committed meanwhile stay as they are. If another snapshot was made meanwhile, that one stays.
        """
        parts = self._parts()
        if not parts.open:
            return
        folder = self._write(_dated(self._live(parts.turns())).hint("rebalance", "day"))
        folded = with_versions(parts.folded, parts.open)
        known = parts.snapshot and parts.snapshot["folder"]

        def still_newest(log: list[tuple[int, Entry]]) -> bool:
            last = [e["folder"] for _, e in log if e["kind"] == "snapshot"][-1:]
            return last == ([known] if known else [])

        if self.log.add({"kind": "snapshot", "folder": folder, "folded": folded}, still_newest) is None:
            self._delete(folder)

    def clean_up(self) -> None:
        """Remove versions that the newest snapshot holds, and older snapshots. Not while others read."""
        log, parts = self.log.read(), self._parts()
        if not parts.snapshot:
            return
        gone = [
            (turn, e["folder"])
            for turn, e in log
            if e["folder"] != parts.snapshot["folder"]
            and (e["kind"] == "snapshot" or covers(parts.folded, e["writer"], e["version"]))
        ]
        self.log.drop(turn for turn, _ in gone)
        for _, folder in gone:
            self._delete(folder)

    def _delete(self, folder: str) -> None:
        for kind in ("rows", "keys"):
            path, files = folder_at(self.spark, f"{self.path}/{kind}/commit={folder}")
            files.delete(path, True)

    def _write(self, rows: DataFrame) -> str:
        """Rows and, from the written copy, their keys, in a folder that nothing names yet.

        Spark evens out the files of a snapshot and of keys: small parts are put together, a large day or bucket is
        split. A version is written from where its keys were resolved, with no second shuffle of its texts.
        """
        folder = uuid.uuid4().hex
        path = f"{self.path}/rows/commit={folder}"
        rows.write.partitionBy("day").option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(f"{schemas.PROCESSED}, day DATE").parquet(path)
        keys = back.select("pk", "rk", "ts", key_bucket(F.col("rk")).alias("bucket"))
        keys.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/keys/commit={folder}")
        return folder

    def _parts(self) -> _Parts:
        log = self.log.read()
        snapshots = [e for _, e in log if e["kind"] == "snapshot"]
        folded = snapshots[-1]["folded"] if snapshots else {}
        found: dict[tuple[str, int], tuple[int, str]] = {}
        for turn, e in log:
            if e["kind"] == "append" and not covers(folded, e["writer"], e["version"]):
                key = (e["writer"], e["version"])
                found[key] = (found.get(key, (turn, ""))[0], e["folder"])
        return _Parts(snapshots[-1] if snapshots else None, found, folded)

    def _read(self, kind: str, schema: str, turns: dict[str, int], *more: Column) -> DataFrame:
        """Rows or keys of some folders with the turn of each, and what `more` tells of their files."""
        if not turns:
            return self.spark.createDataFrame([], f"{schema}, turn BIGINT")
        folders = [f"{self.path}/{kind}/commit={c}" for c in turns]
        rows = self.spark.read.schema(f"{schema}, commit STRING").option("basePath", f"{self.path}/{kind}").parquet(*folders)
        rows = rows.select("*", *more)
        # One row per open commit, as a local table of known size.
        known = self.spark.createDataFrame(pa.table({"commit": list(turns), "turn": pa.array(turns.values(), pa.int64())}))
        return rows.join(known, "commit").drop("commit")

    def _rows(self, turns: dict[str, int]) -> DataFrame:
        return self._read("rows", f"{schemas.PROCESSED}, day DATE", turns)

    def _keys(self, turns: dict[str, int]) -> DataFrame:
        return self._read("keys", "pk STRING, rk STRING, ts TIMESTAMP, bucket INT", turns)

    @staticmethod
    def _resolved(rows: DataFrame) -> DataFrame:
        """One row per key, the one of the last turn; a turn has one row per key."""
        return latest_per_key(rows, F.col("turn").desc())

    def _live(self, turns: dict[str, int]) -> DataFrame:
        """What `_resolved` leaves of the rows, found without moving them: keys and places are shuffled, not texts.

        The places of replaced rows are bits, a bitmap for each file and `_BITS` rows. The bitmaps are settled, so Spark
        knows their size: below the broadcast limit they are sent to the rows, else rows and bitmaps are joined by file.
        """
        at, pos = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index")
        places = (at, F.floor(pos / _BITS).alias("_block"), (pos % _BITS).alias("_bit"))
        rows = self._read("rows", f"{schemas.PROCESSED}, day DATE", turns, *places)
        w = Window.partitionBy("pk", "rk").orderBy(F.col("turn").desc())
        lost = rows.withColumn("_n", F.row_number().over(w)).filter("_n > 1").groupBy("_file", "_block")
        marks = settle(lost.agg(F.bitmap_construct_agg("_bit").alias("_lost")), "replaced")
        octet = F.conv(F.hex(F.substr("_lost", F.expr("int(_bit div 8) + 1"), F.lit(1))), 16, 10).cast("int")
        marked = rows.join(marks, ["_file", "_block"], "left")
        return marked.filter(F.coalesce(F.getbit(octet, (F.col("_bit") % 8).cast("int")), F.lit(0)) == 0)

    def rows(self) -> DataFrame:
        """One row per key, the one written last; a missing table reads as empty."""
        return self._resolved(self._rows(self._parts().turns())).select(*_COLUMNS)

    def keys(self, but: tuple[str, int] | None = None) -> DataFrame:
        """Keys of the table, without those of one version if that is about to be written again."""
        return state_keys(self._keys(self._parts().turns(but)))

    def seen(self, posts: DataFrame, but: tuple[str, int] | None = None) -> DataFrame:
        """The keys of `posts` that the table holds: pk, rk, in place of all keys in a duplicate check.

        Only the buckets of the posts are read. The posts' keys are settled first, so Spark knows their size: while
        it is below the broadcast limit they are sent to the keys, which are then not shuffled.
        """
        asked = settle(with_keys(posts).select("pk", "rk").distinct(), "asked")
        # At most one row per bucket.
        buckets = [r[0] for r in asked.select(key_bucket(F.col("rk"))).distinct().collect()]
        held = self._keys(self._parts().turns(but)).filter(F.col("bucket").isin(buckets))
        return held.select("pk", "rk").join(asked, ["pk", "rk"], "left_semi").distinct()

    def stored_since(self, since: Column) -> DataFrame:
        """What `rows` has with a store time from `since` on; only its days are read.

        A row may be replaced by one of a later turn with an earlier store time. Only versions after the
        snapshot can do that, so their keys are looked at as well, and no others. `since` must not depend on rows.
        """
        parts = self._parts()
        recent = self._rows(parts.turns()).filter((F.col("day") >= F.to_date(since)) & (F.col("ts") >= since))
        later = self._keys(parts.turns(snapshot=False)).groupBy("pk", "rk").agg(F.max("turn").alias("_last"))
        kept = self._resolved(recent).join(later, ["pk", "rk"], "left").filter("_last IS NULL OR _last = turn")
        return kept.select(*_COLUMNS)

    def first_rows(self, n: int) -> DataFrame:
        """The first `n` rows in key order: keys are sorted without their rows, whose days are then read."""
        turns = self._parts().turns()
        keys = self._resolved(self._keys(turns).drop("bucket"))
        first = settle(keys.orderBy("pk", "rk").limit(n).select("pk", "rk", "turn", F.to_date("ts").alias("day")), "first")
        # At most `n` days.
        days = [r[0] for r in first.select("day").distinct().collect()]
        asked = F.col("day").isin([d for d in days if d]) | (F.col("day").isNull() if None in days else F.lit(False))
        found = self._rows(turns).filter(asked).join(first.select("pk", "rk", "turn"), ["pk", "rk", "turn"], "left_semi")
        return found.select(*_COLUMNS)

    def recent_posts(self, as_of: Column, days_since: int = 1, limit: int = 15) -> DataFrame:
        """`recent_posts` of this module over the days asked for."""
        return recent_posts(self.stored_since(_stored_from(as_of, days_since)), as_of, days_since, limit)

    def recent_posts_or_scan(self, as_of: Column, days_since: int = 1, limit: int = 15, scan: int = 500) -> DataFrame:
        """Recent posts, or the scan in key order when there is none; only the one that answers is run."""
        direct = settle(self.recent_posts(as_of, days_since, limit), "recent")
        if direct.limit(1).count():
            return direct
        return recent_fallback_scan(self.first_rows(scan), as_of, days_since, limit, scan)


def string_list(json_text: Column) -> Column:
    """JSON text of a list, empty when missing or unreadable."""
    return F.coalesce(F.from_json(json_text, "array<string>"), no_strings())


def processed_time(processed_date: Column, ts: Column) -> Column:
    return F.coalesce(processed_date.try_cast("timestamp"), ts)


def read_processed(rows: DataFrame) -> DataFrame:
    """State rows with lists for the summaries and the time a post was processed."""
    return rows.withColumns(
        {
            "english_summary": string_list(F.col("english_summary")),
            "korean_summary": string_list(F.col("korean_summary")),
            "processed_time": processed_time(F.col("processed_date"), F.col("ts")),
            "emoji": source_emoji(F.col("source_name"), "recent"),
        }
    )


def _stored_from(as_of: Column, days_since: int) -> Column:
    return F.date_trunc("second", ago(as_of, days=days_since))


def _newest_first(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.col("processed_time").desc(), "pk", "rk", "ts").limit(limit)


def recent_posts(
    rows: DataFrame, as_of: Column, days_since: int = 1, limit: int = 15
) -> DataFrame:
    """The newest rows whose store time is within `days_since` days."""
    recent = rows.filter(F.col("ts") >= _stored_from(as_of, days_since))
    return _newest_first(read_processed(recent), limit)


def recent_fallback_scan(
    rows: DataFrame, as_of: Column, days_since: int = 1, limit: int = 15, scan: int = 500
) -> DataFrame:
    """The first `scan` rows in key order, filtered by processed time."""
    first = read_processed(rows.orderBy("pk", "rk", "ts").limit(scan))
    return _newest_first(first.filter(F.col("processed_time") >= ago(as_of, days=days_since)), limit)


def recent_posts_or_scan(
    rows: DataFrame, as_of: Column, days_since: int = 1, limit: int = 15
) -> DataFrame:
    """Recent posts, or the scan when no row passes the store time filter.

    Both sides hold at most `limit` rows, so the test for emptiness is over a handful.
    """
    direct = recent_posts(rows, as_of, days_since, limit).withColumn("_side", F.lit(0))
    scanned = recent_fallback_scan(rows, as_of, days_since, limit).withColumn("_side", F.lit(1))
    both = direct.unionByName(scanned)
    first = F.min("_side").over(Window.partitionBy(F.lit(0)))
    return both.withColumn("_first", first).filter("_side = _first").drop("_side", "_first")

