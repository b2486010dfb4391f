"""Small helpers that several operators share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import feedloom
from feedloom.functions.text import let

#: White space that keys and normal forms ignore: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows that a Python worker gets at once. Texts can be long, and the default of 10,000 is for narrow rows.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and get few rows at once.

    On a cluster whose machines lack that folder, ship the package with `--py-files`.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.abspath(feedloom.__file__)))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def seeded(seed: str | int, *cols: Column) -> Column:
    """64-bit hash of the columns under a seed."""
    return F.xxhash64(F.lit(seed), *cols)


def without_blanks(c: Column) -> Column:
    """The text without any of `BLANKS`."""
    for blank in BLANKS:
        c = F.replace(c, F.lit(blank), F.lit(""))
    return c


def wrapped(docs: DataFrame) -> DataFrame:
    """Each row as one struct `_doc`, so that no name of its columns can meet a name used on the way."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def unwrapped(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of `_doc` again; `changed` ones have new values."""
    return rows.select(*[changed.get(c, F.col("_doc")[c]).alias(c) for c in columns])


#: Elements that a fold over an array gathers before it starts a new list.
_GATHERED = 512


def gathered(
    items: Column, start: Column, carry: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str
) -> Column:
    """What `emit` gives for each element and what is carried so far, one after the other, as an array of `kind`.

    `carry` gives what is carried on from `start`. A list that grows by one element costs all of its length each time; so
    short lists are gathered and put together at the end, and the work stays linear.
    """
    none, lists = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def step(state: Column, x: Column) -> Column:
        return F.struct(
            carry(state["c"], x).alias("c"), F.concat(state["out"], emit(state["c"], x)).alias("out")
        )

    def part(held: Column) -> Callable[[Column, Column], Column]:
        def of(state: Column, i: Column) -> Column:
            some = F.slice(held, i * _GATHERED + 1, F.lit(_GATHERED))
            done = F.aggregate(some, F.struct(state["c"].alias("c"), none.alias("out")), step)
            return let(
                done,
                lambda d: F.struct(d["c"].alias("c"), F.concat(state["lists"], F.array(d["out"])).alias("lists")),
            )

        return of

    def walk(held: Column) -> Column:
        parts = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / F.lit(_GATHERED)).cast("int"))
        whole = F.aggregate(
            parts, F.struct(start.alias("c"), lists.alias("lists")), part(held), lambda s: F.flatten(s["lists"])
        )
        return F.when(F.size(held) > 0, whole).otherwise(none)

    return let(items, walk)


#: Code points of a piece of a text, and of the larger parts that it is cut to first.
PIECE = 1024
_PART = 64 * PIECE


def text_pieces(text: Column) -> Column:
    """The text as pieces of `PIECE` code points. Finding a place in a text means walking to it, in a piece not far."""

    def cut(t: Column, size: int) -> Column:
        ends = F.sequence(F.lit(0), F.floor(F.greatest(F.char_length(t) - 1, F.lit(0)) / F.lit(size)).cast("int"))
        return F.transform(ends, lambda i: F.substr(t, i * size + 1, F.lit(size)))

    return let(text, lambda t: F.flatten(F.transform(cut(t, _PART), lambda s: cut(s, PIECE))))


def cut_pieces(pieces: Column, start: Column, stop: Column) -> Column:
    """Code points from `start` to before `stop` of the text that was cut to pieces."""
    first = F.floor(start / F.lit(PIECE)).cast("int")
    last = F.floor(F.greatest(stop, start) / F.lit(PIECE)).cast("int")
    # Mostly one piece or two, which are looked up; a slice copies the whole array first.
    one, two = F.coalesce(F.get(pieces, first), F.lit("")), F.coalesce(F.get(pieces, first + 1), F.lit(""))
    near = (
        F.when(last == first, one)
        .when(last == first + 1, F.concat(one, two))
        .otherwise(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""))
    )
    return F.substr(near, start - first * PIECE + 1, F.greatest(stop - start, F.lit(0)))


def blocked(rows: DataFrame, key: str, n: str, id_col: str, keep: list[str], block_rows: int) -> DataFrame:
    """Rows dealt to pairs of blocks (`p` <= `q`) of about `block_rows` rows of a key that has `n` rows.

    A key of one block keeps its rows once; in a larger one every two rows meet in one pair of
    blocks. `mine` is the block of the row.
    """
    count = F.ceil(F.col(n) / block_rows).cast("int")
    dealt = rows.withColumn("_blocks", count).withColumn(
        "mine", F.pmod(F.xxhash64(id_col, F.lit("block")), F.col("_blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return dealt.withColumn("_other", other).select(
        key, F.least("mine", "_other").alias("p"), F.greatest("mine", "_other").alias("q"), "mine", id_col, *keep
    )


def in_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys in sorted batches; a run is held back until the next key is seen."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch[keys].to_numpy()
        starts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1), len(batch)]
        for lo, hi in zip(starts[:-1], starts[1:]):
            run = batch.iloc[lo:hi]
            if held and (held[-1][keys].iloc[-1].to_numpy() != run[keys].iloc[0].to_numpy()).any():
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(run)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def fresh_name(df: DataFrame, wanted: str) -> str:
    """A column name that `df` does not use (names are compared without case)."""
    used = {c.lower() for c in df.columns}
    while wanted.lower() in used:
        wanted = f"_{wanted}"
    return wanted
