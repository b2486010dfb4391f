"""Best-fit packing of token runs into sequences of several permitted lengths.

Runs of the same length are interchangeable, so the plan is made on the number of runs of each
length. That table has at most as many rows as the longest permitted sequence has tokens, however
large the corpus; the runs themselves are numbered and sent to their places by Spark.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import on_workers, seeded, whole_text
from feedloom.session import settle

#: Production parameters. Lengths are in byte tokens: no byte-level tokenizer makes more of a text.
CAPACITIES = (2048, 4096, 8192, 16384)
#: What a sequence costs besides its tokens: the start, attention and padding bookkeeping of a row.
OVERHEAD = 64
#: Parts that the runs of one length are numbered in.
PARTS = 128


@dataclass
class Plan:
    """Places for runs: `take[i]` runs of `length[i]`, from number `first[i]` on, `per_bin[i]` to a bin."""

    length: np.ndarray
    first: np.ndarray
    bin: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray
    #: Start of each range of bins with the same contents, and their final capacity and fill.
    range_start: np.ndarray
    range_capacity: np.ndarray
    range_fill: np.ndarray


def cheapest(length: int, left: int, capacities: tuple[int, ...], overhead: int) -> int:
    """The permitted size to open for `left` runs of a length: least cost per token put into it.

    A larger bin is worth it when more runs fit it; equal costs take the smaller bin.
    """
    fits = [c for c in capacities if c >= length]
    return min(fits, key=lambda c: ((c + overhead) / (min(c // length, left) * length), c))


def plan_bins(
    counts: list[tuple[int, int]], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD
) -> Plan:
    """Best fit, longest runs first, for (length, number of runs).

    Each run goes to the open bin with the least room that still holds it (the earliest opened
    among equals); if there is none, the cheapest size is opened. In the end each bin is cut down
    to the least permitted size that holds its contents. Bins with equal contents are handled as
    one range, so the work follows the number of lengths, not of runs.
    """
    capacities = tuple(sorted(capacities))
    rooms: list[int] = []  # rooms that some open range has, ascending
    ranges: dict[int, list[tuple[int, int, int]]] = {}  # room -> heap-like list of (start, count, fill)
    events: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(room: int, start: int, count: int, fill: int) -> None:
        if room not in ranges:
            ranges[room] = []
            bisect.insort(rooms, room)
        bisect.insort(ranges[room], (start, count, fill))

    def pop(room: int) -> tuple[int, int, int]:
        found = ranges[room].pop(0)
        if not ranges[room]:
            del ranges[room]
            rooms.pop(bisect.bisect_left(rooms, room))
        return found

    def fill_range(room: int, start: int, count: int, fill: int, length: int, left: int, number: int) -> int:
        """Put up to `left` runs into a range; returns how many went in."""
        each = room // length
        full = min(count, left // each)
        taken = full * each
        if full:
            events.append((length, number, start, each, fill))
            put(room - each * length, start, full, fill + each * length)
        rest = left - taken
        if full < count and 0 < rest:
            events.append((length, number + taken, start + full, rest, fill))
            put(room - rest * length, start + full, 1, fill + rest * length)
            taken, full = taken + rest, full + 1
        if full < count:
            put(room, start + full, count - full, fill)
        return taken

    for length, left in sorted(counts, reverse=True):
        number = 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                start, count, fill = pop(room)
            else:
                room, fill = cheapest(length, left, capacities, overhead), 0
                each = room // length
                start, count = bins, max(1, left // each)
                bins += count
            took = fill_range(room, start, count, fill, length, left, number)
            number, left = number + took, left - took

    closed = sorted((s, f) for group in ranges.values() for s, _, f in group)
    starts = np.array([s for s, _ in closed], dtype=np.int64)
    fills = np.array([f for _, f in closed], dtype=np.int64)
    sizes = np.array(capacities, dtype=np.int64)
    columns = np.array(events, dtype=np.int64).reshape(-1, 5)
    columns = columns[np.lexsort((columns[:, 1], columns[:, 0]))]
    return Plan(
        *(columns[:, i] for i in range(5)), starts, sizes[np.searchsorted(sizes, fills)], fills
    )


def token_runs(docs: DataFrame, id_col: str, tokens: Column, longest: int) -> DataFrame:
    """Runs of at most `longest` tokens: row, id, run, start, length. A row without tokens has none.

    A text beyond the longest sequence becomes several full runs and a rest; nothing is cut off.
    """
    sized = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"),
    ).filter("tokens > 0")
    run = F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(longest).cast("long")))
    return sized.select("row", "id", "tokens", run.alias("run", "start")).select(
        "row", "id", "run", "start", F.least(F.col("tokens") - F.col("start"), F.lit(longest)).alias("length")
    )


def _numbered(runs: DataFrame) -> DataFrame:
    """Runs with their number (0, 1, ...) among the runs of the same length.

    The order is that of a hash, so the runs of a frequent length are numbered in `PARTS` parts,
    each from where the parts before it end.
    """
    h = seeded("order", F.col("row"), F.col("run"))
    parted = runs.withColumn("_h", h).withColumn(
        "_part", (F.shiftrightunsigned("_h", 32) * PARTS / (1 << 32)).cast("int")
    )
    sizes = parted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(
        Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    )
    before = sizes.select("length", "_part", (upto - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_h", "row", "run"))
    ranked = parted.withColumn("_rank", rank)
    return ranked.join(before, ["length", "_part"]).select(
        "id", "run", "start", "length", (F.col("_before") + F.col("_rank") - 1).alias("number")
    )


def _placer(plan: Plan):
    """Looks up each run's bin; the plan is bounded by the longest permitted sequence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            lo = np.searchsorted(plan.length, length, side="left")
            hi = np.searchsorted(plan.length, length, side="right")
            # The last of a length's entries that starts at or before the number, by halves.
            while (hi - lo > 1).any():
                mid = (lo + hi) // 2
                right = plan.first[np.minimum(mid, len(plan.first) - 1)] <= number
                open_ = hi - lo > 1
                lo = np.where(open_ & right, mid, lo)
                hi = np.where(open_ & ~right, mid, hi)
            ahead = number - plan.first[lo]
            at = plan.bin[lo] + ahead // plan.per_bin[lo]
            which = np.searchsorted(plan.range_start, at, side="right") - 1
            yield batch.drop(columns=["number"]).assign(
                bin=at,
                offset=plan.offset[lo] + (ahead % plan.per_bin[lo]) * length,
                capacity=plan.range_capacity[which],
                fill=plan.range_fill[which],
            )

    return run


def pack(
    docs: DataFrame,
    tokens: Column,
    id_col: str = "doc_id",
    capacities: tuple[int, ...] = CAPACITIES,
    overhead: int = OVERHEAD,
) -> DataFrame:
    """Place every token of every row into a sequence; one row per run.

    Returns id, run, start and length (which tokens of the row), bin, offset (place in the
    sequence), capacity (one of `capacities`) and fill (tokens in the sequence). A row with
    null or no tokens needs no place and yields nothing; null and repeated ids and any other
    columns are no matter. The driver sees the number of runs of each length, at most
    max(capacities) rows, and sends the plan of as many ranges to the tasks.
    """
    on_workers(docs.sparkSession)
    runs = settle(token_runs(docs, id_col, tokens, max(capacities)), "runs")
    lengths = runs.groupBy("length").agg(F.count("*").alias("n")).collect()
    plan = plan_bins([(r["length"], r["n"]) for r in lengths], capacities, overhead)
    id_type = runs.schema["id"].dataType.simpleString()
    return _numbered(runs).mapInPandas(
        _placer(plan),
        f"id {id_type}, run INT, start BIGINT, length BIGINT, bin BIGINT, offset BIGINT, capacity BIGINT, fill BIGINT",
    )


def byte_tokens(text_col: str = "text") -> Column:
    return F.octet_length(whole_text(text_col))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents as byte tokens, packed into sequences of 2,048 to 16,384 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, byte_tokens()).withColumnRenamed("id", "doc_id")
