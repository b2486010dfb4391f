"""Near-dedup of texts: BagMinHash signatures, bands, and the exact overlap of shingle bags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm import bagminhash
from feedloom.llm.common import blocked, in_runs, on_workers, seeded, unwrapped, whole_text, wrapped
from feedloom.llm.components import components
from feedloom.session import settle

#: Production parameters. A pair at the threshold shares a band with a chance of 0.9999.
WORDS = 5
MIN_SIMILARITY = 0.8
BANDS = 30
BAND_ROWS = 6

#: Rows of a band that one task compares at once, and shingles that those may have on average.
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 20

#: Bags that a task keeps parsed while it compares pairs.
_PARSED = 64


def _printer(words: int, bands: int, band_rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                keys, weights = bagminhash.shingles(text, words)
                if len(keys):
                    sig = bagminhash.signature(keys, weights, bands * band_rows)
                    short = (sig & np.uint64(0xFFFF)).astype(np.uint16).tobytes()
                    out.append(
                        (int(weights.sum()), *bagminhash.bag_keys(keys, weights), bagminhash.bands(sig, band_rows), short)
                    )
                else:
                    out.append((0, 0, 0, [], b""))
            found = pd.DataFrame(out, columns=["n", "k1", "k2", "bands", "sig"], index=batch.index)
            yield pd.concat([batch.drop(columns=["text"]), found], axis=1)

    return run


def _verifier(words: int, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed: dict[int, tuple] = {}

        def bag(place: int, text: str) -> tuple:
            if place not in parsed:
                if len(parsed) >= _PARSED:
                    del parsed[next(iter(parsed))]
                parsed[place] = bagminhash.shingles(text, words)
            return parsed[place]

        for batch in batches:
            linked = [
                bagminhash.overlap(bag(a, x), bag(b, y)) >= least
                for a, b, x, y in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"])
            ]
            yield batch.loc[linked, ["a", "b"]]

    return run


def _open_pairs(group: pd.DataFrame, size_ratio: float, close) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (x, y) of a block of a band, of groups that are still apart, of sizes that can reach the threshold, and `close`.

    A pair is told in the first band that it shares only: it is open there as well.
    """
    bands, here = np.array(group["bands"].tolist()), group["band"].iloc[0]
    place, n, of = (group[c].to_numpy() for c in ("place", "n", "component"))
    every = np.arange(len(group))
    if group["p"].iloc[0] == group["q"].iloc[0]:
        left, right = every, every
    else:
        own = (group["mine"] == group["p"]).to_numpy()
        left, right = every[own], every[~own]
    for at in range(0, len(left), 64):
        rows = left[at : at + 64]
        good = of[rows][:, None] != of[right][None, :]
        good &= place[rows][:, None] < place[right][None, :] if left is right else True
        small = np.minimum(n[rows][:, None], n[right][None, :])
        good &= small >= size_ratio * np.maximum(n[rows][:, None], n[right][None, :])
        i = np.flatnonzero(good.any(axis=1))
        if not len(i):
            continue
        good[i] &= close(rows[i], right)
        x, y = np.nonzero(good)
        x, y = rows[x], right[y]
        first = bands[x, (bands[x] == bands[y]).argmax(axis=1)] == here
        yield x[first], y[first]


def _agreeing(least: float, size_ratio: float):
    """Open pairs within a block of a band whose signatures agree enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in in_runs(batches, ["band", "p", "q"]):
            sig = np.array([np.frombuffer(x, dtype=np.uint16) for x in group["sig"]])
            place = group["place"].to_numpy()
            for x, y in _open_pairs(group, size_ratio, lambda i, j: bagminhash.agreement(sig[i], sig[j]) >= least):
                a, b = place[x], place[y]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _binned(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins = [bagminhash.bins(*bagminhash.shingles(text, words)).tobytes() for text in batch["text"]]
            yield pd.DataFrame({"place": batch["place"], "bins": bins})

    return run


def _possible(bins: np.ndarray, n: np.ndarray, least: float):
    """Pairs whose overlap, were all shingles of a bin the same, would do: never fewer than those that link."""

    def close(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        most = bagminhash.most_common(bins[i], bins[j])
        return most / (n[i][:, None] + n[j][None, :] - most) >= least

    return close


def _undecided(least: float):
    """Rows of a block of a band, once each, that are in an open pair which may link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in in_runs(batches, ["band", "p", "q"]):
            bins = np.array([np.frombuffer(x, dtype=np.int32) for x in group["bins"]])
            found = np.zeros(len(group), dtype=bool)
            for x, y in _open_pairs(group, least, _possible(bins, group["n"].to_numpy(), least)):
                found[x] = found[y] = True
            yield group.loc[found, ["band", "place"]]

    return run


def _linking(words: int, least: float):
    """Open pairs within a block of a band whose bags overlap enough, fewer than the block has groups.

    A pair whose groups the block has joined already is not compared.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in in_runs(batches, ["band", "p", "q"]):
            bags = [bagminhash.shingles(text, words) for text in group["text"]]
            bins = np.array([bagminhash.bins(*bag) for bag in bags])
            place, n, of = group["place"].to_numpy(), group["n"].to_numpy(), group["component"].to_numpy().copy()
            starts = np.cumsum([0, *(len(keys) for keys, _ in bags)])
            known, at = np.unique(np.concatenate([keys for keys, _ in bags]), return_inverse=True)
            weights = np.concatenate([w for _, w in bags])
            own = np.zeros(len(known), dtype=np.int64)
            links = []
            for xs, ys in _open_pairs(group, least, _possible(bins, n, least)):
                for x in np.unique(xs):
                    others = ys[xs == x]
                    others = others[of[others] != of[x]]
                    if not len(others):
                        continue
                    mine = at[starts[x] : starts[x + 1]]
                    own[mine] = weights[starts[x] : starts[x + 1]]
                    for y in others:
                        if of[y] == of[x]:
                            continue
                        theirs = slice(starts[y], starts[y + 1])
                        both = int(np.minimum(own[at[theirs]], weights[theirs]).sum())
                        if both / (int(n[x]) + int(n[y]) - both) >= least:
                            links.append((min(place[x], place[y]), max(place[x], place[y])))
                            of[of == of[y]] = of[x]
                    own[mine] = 0
            yield pd.DataFrame(links, columns=["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) of places whose bags overlap enough. Only texts that occur in pairs move."""
    asked = settle(pairs, "pairs")
    wanted = asked.select(F.col("a").alias("place")).union(asked.select(F.col("b").alias("place"))).distinct()
    used = texts.join(wanted, "place", "left_semi")
    both = asked.join(
        used.select(F.col("place").alias("a"), F.col("text").alias("text_a")), "a"
    ).join(used.select(F.col("place").alias("b"), F.col("text").alias("text_b")), "b")
    return settle(both.mapInPandas(_verifier(words, least), "a BIGINT, b BIGINT"), "links")


def _alike(least: float):
    """Bags of these sizes can reach the threshold."""
    small, large = F.least("n", "other_n"), F.greatest("n", "other_n")
    return small >= large * least


def _still_open(crowded: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the bands whose classes are not one group, with their group (`component`)."""
    labelled = crowded.select("band", "size", "place", "n").join(
        found.select(F.col("id").alias("place"), "component"), "place", "left"
    ).withColumn("component", F.coalesce("component", "place"))
    apart = (
        labelled.groupBy("band")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low <> high")
        .select("band")
    )
    return settle(labelled.join(apart, "band", "left_semi"), "open")


def _in_blocks(rows: DataFrame, keep: list[str]) -> DataFrame:
    dealt = blocked(rows, "band", "size", "place", keep, BLOCK_ROWS)
    return dealt.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    min_similarity: float = MIN_SIMILARITY,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """Groups of near-duplicates; one row per row of `docs`: row, place, id, n
    (shingles), class_id, group_id, group_size, kept.

    Bags of `words`-word shingles (lower case, parted by blanks) link when their weighted Jaccard
    similarity is at least `min_similarity`; a group is what links connect. A text of fewer words
    is one shingle; a null, empty or blank text links with nothing and stays. Rows with equal
    bags are one class, named by its smallest id, and are never compared with each other. Of each
    group the row with the smallest id stays (null ids last). Other columns are ignored.

    Classes that share a band are candidates. First each is compared with the first class of
    its bands. Then, within bands whose classes are not yet one group, signatures are held against each
    other, block by block, and likely links are compared in full. Last, by the groups these make, all
    pairs that share a band and are still apart are decided by their bags, whatever their signatures
    say: counts of shingles in bins, an upper limit of the overlap, show which rows can link at all,
    and the texts of those meet in the blocks. So a large group of near copies costs few comparisons,
    no list of all its pairs is made, and no pair that shares a band is left undecided.
    """
    on_workers(docs.sparkSession)
    text = whole_text(text_col)
    placed = docs.select(
        F.col(f"`{id_col}`").alias("id"), text.alias("text"), seeded("place", F.col(f"`{id_col}`"), text).alias("place")
    )
    id_type = placed.schema["id"].dataType.simpleString()
    prints = settle(
        placed.select(F.monotonically_increasing_id().alias("row"), "id", "place", "text").mapInPandas(
            _printer(words, bands, band_rows),
            f"row BIGINT, id {id_type}, place BIGINT, n BIGINT, k1 BIGINT, k2 BIGINT, bands ARRAY<BIGINT>, sig BINARY",
        ),
        "signatures",
    )
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row", "place")).alias("head")
    classes = settle(
        prints.filter("n > 0")
        .groupBy("k1", "k2", "n")
        .agg(first)
        .select("k1", "k2", "n", F.col("head.row").alias("row"), F.col("head.place").alias("place"), F.col("head.id").alias("class_id")),
        "classes",
    )
    # Bands and signatures stay with the first row of each class.
    heads_of = prints.select("row", "bands", "sig").join(classes.select("row", "place", "n"), "row")
    banded = heads_of.select("place", "n", F.explode("bands").alias("band"))
    heads = (
        banded.groupBy("band")
        .agg(F.count("*").alias("size"), F.min(F.struct("place", "n")).alias("head"))
        .filter("size > 1")
        .select("band", "size", F.col("head.place").alias("other"), F.col("head.n").alias("other_n"))
    )
    crowded = settle(banded.join(heads, "band").select("band", "size", "place", "n", "other", "other_n"), "bands")
    members = crowded.select("place").distinct()
    # One way of joining at every size: the texts are dealt by place once, and only candidates stay.
    texts = settle(
        placed.select("place", "text")
        .join(members.hint("merge"), "place", "left_semi")
        .groupBy("place")
        .agg(F.first("text").alias("text")),
        "texts",
    )
    first_pairs = (
        crowded.filter(F.col("place") != F.col("other"))
        .filter(_alike(min_similarity))
        .select(F.least("other", "place").alias("a"), F.greatest("other", "place").alias("b"))
        .distinct()
    )
    links = _verified(first_pairs, texts, words, min_similarity)
    found = settle(components(links), "groups")
    signed = heads_of.join(members, "place", "left_semi").select("place", "sig", "bands")

    open_rows = _still_open(crowded, found).join(signed, "place")
    agreeing = (
        _in_blocks(open_rows, ["n", "component", "sig", "bands"])
        .mapInPandas(_agreeing(min_similarity, min_similarity), "a BIGINT, b BIGINT")
        .distinct()
        .join(first_pairs, ["a", "b"], "left_anti")
    )
    further = _verified(agreeing, texts, words, min_similarity)
    if further.limit(1).count():
        links = links.unionByName(further)
        found = settle(components(links), "groups")

    # No test by signatures here: every pair that is still apart is decided.
    left_open = _still_open(crowded, found)
    bins = texts.join(left_open.select("place").distinct(), "place", "left_semi").mapInPandas(
        _binned(words), "place BIGINT, bins BINARY"
    )
    banded_bins = left_open.join(signed.select("place", "bands"), "place").join(bins, "place")
    undecided = settle(
        _in_blocks(banded_bins, ["n", "component", "bins", "bands"])
        .mapInPandas(_undecided(min_similarity), "band BIGINT, place BIGINT")
        .distinct(),
        "undecided",
    )
    asked = left_open.drop("size").join(undecided, ["band", "place"], "left_semi")
    held = F.greatest(F.count("*"), F.ceil(F.sum("n") * BLOCK_ROWS / BLOCK_SHINGLES))
    sized = asked.join(asked.groupBy("band").agg(held.alias("size")), "band")
    last = settle(
        _in_blocks(
            sized.join(signed.select("place", "bands"), "place").join(
                texts.join(undecided.select("place").distinct(), "place", "left_semi"), "place"
            ),
            ["n", "component", "bands", "text"],
        ).mapInPandas(_linking(words, min_similarity), "a BIGINT, b BIGINT"),
        "links",
    )
    if last.limit(1).count():
        links = links.unionByName(last)
        found = settle(components(links), "groups")

    grouped = classes.select("k1", "k2", "n", "place", "class_id").join(
        found.select(F.col("id").alias("place"), "component"), "place", "left"
    )
    named = prints.select("row", "place", "id", "n", "k1", "k2").join(
        grouped.select("k1", "k2", "n", "class_id", F.coalesce("component", "place").alias("component")),
        ["k1", "k2", "n"],
        "left",
    )
    named = settle(named.select("row", "place", "id", "n", "class_id", "component"), "named")
    stays = named.filter("component IS NOT NULL").groupBy("component").agg(
        F.count("*").alias("group_size"), F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row")).alias("head")
    )
    alone = F.col("head").isNull()
    return named.join(stays, "component", "left").select(
        "row",
        "place",
        "id",
        "n",
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("group_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("head.row"))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without the rows that `near_duplicates` does not keep; columns stay as they are.

    Rows are found again by a hash of id and text. Of rows that agree in both, which are one
    group, one stays.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    fate = found.groupBy(F.col("place").alias("_place")).agg(
        F.max("kept").alias("_kept"), (F.count("*") > 1).alias("_again"), F.min("n").alias("_n")
    )
    # Rows that stay as they are need no word; wordless rows link with nothing and all stay.
    said = settle(fate.filter("NOT _kept OR (_again AND _n > 0)").drop("_n"), "fate")
    doc = F.col("_doc")
    place = seeded("place", doc[id_col], F.coalesce(doc[text_col], F.lit("")))
    joined = wrapped(docs).withColumn("_at", place).join(said, F.col("_at") == F.col("_place"), "left")
    out = unwrapped(joined.filter("_place IS NULL"), docs.columns)
    if said.filter("_kept AND _again").limit(1).count():
        once = joined.filter("_kept AND _again").dropDuplicates(["_at"])
        out = out.unionByName(unwrapped(once, docs.columns))
    return out


def op9_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-dedup of all documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "group_id", "group_size", "kept")
