"""Embedding near-dedup by lattice hashing.

Random projections of each vector are decoded to E8 points in several tables. A vector lies in
its own cell of a table and looks into the neighbouring cells that are nearest to it; vectors that
meet in a cell are compared by cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm import lattice
from feedloom.llm.common import blocked, in_runs, on_workers
from feedloom.llm.components import components
from feedloom.session import settle

#: Production parameters. A pair at the threshold meets in one table with a chance of about 0.6.
MIN_COSINE = 0.95
TABLES = 8
BLOCKS = 3
PROBES = 14
#: Lattice units per unit of projected length at 64 dimensions.
SCALE = 3.5
SEED = 7
#: Vectors of a cell or component that one task compares at once.
BLOCK_ROWS = 1024

#: Neighbours of each block that are weighed for probing.
_NEAR = 4


def projections(dim: int, tables: int, blocks: int, scale: float, seed: int) -> np.ndarray:
    """(tables, 8 * blocks, dim) directions, orthogonal within a table where `dim` allows it."""
    rng = np.random.default_rng([seed, dim])
    rows, out = 8 * blocks, []
    for _ in range(tables):
        g = rng.normal(size=(dim, rows))
        q = np.linalg.qr(g)[0] if dim >= rows else g / math.sqrt(dim)
        out.append(q.T * scale * math.sqrt(dim / 64))
    return np.array(out)


def _hash_weights(tables: int, blocks: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng([seed, 99])
    return rng.integers(-(1 << 63), (1 << 63) - 1, size=(tables, blocks, 9), dtype=np.int64) | 1


def cells_of(
    unit: np.ndarray, tables: int, blocks: int, probes: int, scale: float, seed: int
) -> np.ndarray:
    """Cell ids (n, tables, 1 + probes) of unit vectors; the first of a table is the own cell."""
    directions = projections(unit.shape[1], tables, blocks, scale, seed)
    weights = _hash_weights(tables, blocks, seed)
    # Every choice of own or near cell per block, own cells first.
    choices = np.array(np.meshgrid(*[np.arange(_NEAR + 1)] * blocks, indexing="ij")).reshape(blocks, -1).T
    out = np.empty((len(unit), tables, 1 + probes), dtype=np.int64)
    with np.errstate(over="ignore"):
        for t in range(tables):
            at = unit @ directions[t].T
            home = np.full(len(unit), weights[t, 0, 8], dtype=np.int64)
            gains, steps = [], []
            for b in range(blocks):
                x = at[:, 8 * b : 8 * b + 8]
                point = lattice.nearest(x)
                home += (np.rint(point * 2).astype(np.int64) * weights[t, b, :8]).sum(axis=1)
                index, gain = lattice.next_nearest(x, point, _NEAR)
                moved = (np.rint(lattice.NEIGHBOURS * 2).astype(np.int64) * weights[t, b, :8]).sum(axis=1)
                zero = np.zeros((len(unit), 1))
                gains.append(np.hstack([zero, gain]))
                steps.append(np.hstack([zero.astype(np.int64), moved[index]]))
            total = sum(gains[b][:, choices[:, b]] for b in range(blocks))
            total[:, 0] = -1.0
            best = np.argpartition(total, probes, axis=1)[:, : probes + 1]
            order = np.argsort(np.take_along_axis(total, best, axis=1), axis=1, kind="stable")
            best = np.take_along_axis(best, order, axis=1)
            for b in range(blocks):
                picked = choices[:, b][best]
                part = np.take_along_axis(steps[b], picked, axis=1)
                out[:, t, :] = part if b == 0 else out[:, t, :] + part
            out[:, t, :] += home[:, None]
    return out


def _units(column: pd.Series) -> np.ndarray:
    m = np.array(column.tolist(), dtype=np.float64)
    # Scaled first, so that squares of very large or small components stay finite.
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _cell_rows(tables: int, blocks: int, probes: int, scale: float, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["v"].map(len)
            for dim in sorted(sizes.unique()):
                part = batch[sizes == dim]
                for at in range(0, len(part), 4096):
                    some = part.iloc[at : at + 4096]
                    cells = cells_of(_units(some["v"]), tables, blocks, probes, scale, seed)
                    cells += np.int64(dim)
                    flat = cells.reshape(len(some), -1)
                    own = np.zeros(cells.shape[1:], dtype=bool)
                    own[:, 0] = True
                    yield pd.DataFrame(
                        {
                            "cell": flat.ravel(),
                            "id": np.repeat(some["id"].to_numpy(), flat.shape[1]),
                            "own": np.tile(own.ravel(), len(some)),
                        }
                    )

    return run


def _spread(parts: np.ndarray) -> np.ndarray:
    """For each row of a boolean link matrix, the smallest index that its links lead to."""
    label = np.arange(len(parts))
    while True:
        low = np.where(parts, label[None, :], len(parts)).min(axis=1)
        low = np.minimum(low, label)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _close(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    return a @ b.T >= least


def _star_links(least: float):
    """Links that connect what is connected within a pair of blocks, as stars: no list of all pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out_a, out_b = [], []
        for group in in_runs(batches, ["cell", "p", "q"]):
            if len(group) > 1:
                ids = group["id"].to_numpy()
                order = np.argsort(ids)
                ids = ids[order]
                lengths = group["v"].map(len).to_numpy()[order]
                if (lengths != lengths[0]).any():
                    # Cells of other dimensions share an id only by a clash of hashes.
                    groups = [np.flatnonzero(lengths == d) for d in np.unique(lengths)]
                else:
                    groups = [np.arange(len(ids))]
                vectors = group["v"].to_numpy()[order]
                for g in groups:
                    m = _units(pd.Series(vectors[g]))
                    label = _spread(_close(m, m, least))
                    tied = np.flatnonzero(label != np.arange(len(g)))
                    out_a.append(ids[g][tied])
                    out_b.append(ids[g][label[tied]])
            if sum(map(len, out_a)) > 50_000:
                yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})
                out_a, out_b = [], []
        if out_a:
            yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return run


def _link_counts(least: float):
    """For each vector of a pair of blocks, how many copies it links with there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in in_runs(batches, ["cell", "p", "q"]):
            ids, copies = group["id"].to_numpy(), group["copies"].to_numpy()
            m = _units(group["v"])
            if group["p"].iloc[0] == group["q"].iloc[0]:
                near = _close(m, m, least)
                np.fill_diagonal(near, False)
                yield pd.DataFrame({"id": ids, "n": near @ copies})
            else:
                left = (group["mine"] == group["p"]).to_numpy()
                near = _close(m[left], m[~left], least)
                yield pd.DataFrame({"id": ids[left], "n": near @ copies[~left]})
                yield pd.DataFrame({"id": ids[~left], "n": near.T @ copies[left]})

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    min_cosine: float = MIN_COSINE,
    tables: int = TABLES,
    blocks: int = BLOCKS,
    probes: int = PROBES,
    scale: float = SCALE,
    seed: int = SEED,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per row of `vectors`: id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    nor do vectors of different dimensions. Rows with the same vector are one class: they link
    with each other without being compared. n_links counts the other rows linked directly (cosine
    of at least `min_cosine`, in double precision), component_id is the smallest id reachable by
    links, kept says whether it is the row's own. A null id links with nothing and is kept.

    Connectivity comes from stars within cells; direct links are then counted within each
    component, block by block, so that no list of all pairs ever exists and a link inside a
    component is found whether or not its ends shared a cell. A cell or component of any size is
    dealt out in blocks of `block_rows`.
    """
    spark = vectors.sparkSession
    on_workers(spark)
    doubles = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: x)
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), doubles.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(
        F.col("id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False)
    )
    # Zero and minus zero are one value.
    rows = rows.select("id", F.when(usable, F.transform("v", lambda x: x + 0.0)).alias("v"))
    digest = [F.xxhash64("v").alias("d1"), F.xxhash64(F.lit("again"), "v").alias("d2")]
    tagged = rows.filter("v is not null").select("id", "v", *digest)
    classes = settle(
        tagged.groupBy("d1", "d2").agg(
            F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v")
        ),
        "vectors",
    )

    mapped = classes.select("id", "v").mapInPandas(
        _cell_rows(tables, blocks, probes, scale, seed), "cell BIGINT, id BIGINT, own BOOLEAN"
    )
    placed = settle(mapped, "cells")
    # A cell matters where a vector at home in it meets another one.
    shared = (
        placed.groupBy("cell")
        .agg(F.count("*").alias("n"), F.max("own").alias("home"))
        .filter("n > 1 AND home")
        .select("cell", "n")
    )
    members = placed.join(shared, "cell").select("cell", "n", "id")
    filled = members.join(classes.select("id", "v"), "id")
    dealt = blocked(filled, "cell", "n", "id", ["v"], block_rows)
    grouped = dealt.repartition("cell", "p", "q").sortWithinPartitions("cell", "p", "q")
    stars = grouped.mapInPandas(_star_links(min_cosine), "a BIGINT, b BIGINT").distinct()
    found = settle(components(stars), "components")

    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    inside = (
        found.join(sizes, "component")
        .join(classes.select("id", "v", "copies"), "id")
        .withColumnRenamed("component", "cell")
    )
    dealt = blocked(inside, "cell", "n", "id", ["v", "copies"], block_rows)
    counted = (
        dealt.repartition("cell", "p", "q")
        .sortWithinPartitions("cell", "p", "q")
        .mapInPandas(_link_counts(min_cosine), "id BIGINT, n BIGINT")
        .groupBy("id")
        .agg(F.sum("n").alias("far"))
    )
    per_class = (
        classes.select("id", "d1", "d2", "copies").join(found, "id", "left").join(counted, "id", "left")
    ).select(
        "d1", "d2", F.coalesce("component", "id").alias("component"),
        (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("links"),
    )
    named = rows.select("id", *[F.when(F.col("v").isNotNull(), d).alias(n) for d, n in zip(digest, ("d1", "d2"))])
    return named.join(per_class, ["d1", "d2"], "left").select(
        "id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def op7_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-dedup of all embeddings."""
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumnRenamed("id", "vec_id")
