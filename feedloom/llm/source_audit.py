"""Source divergence audit: how far the words of a source are from those of its language.

Every (lang, source) group is held against the other sources of its language (part `pair`) and against
the language as a whole (part `term`: the words that stand out most). Shares are smoothed by one and
taken in billionths, so all arithmetic is on integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import on_workers
from feedloom.llm.terms import LETTERS
from feedloom.session import settle

#: Production parameters.
MIN_DOCUMENTS = 3
TOP = 200
SCALE = 1_000_000_000

#: Counts that a task holds before it sums them, and passes them on if half as many are left.
HELD = 3_000_000
#: Rows of a group that are held against its skyband at once.
CHUNK = 2048
#: Terms and sources of one tile of a comparison of sources.
TILE_TERMS, TILE_SOURCES = 4096, 64
#: Skybands of one group that a task merges; more of them are merged level by level.
FAN = 32

_COUNTS = "lang STRING, source STRING, term STRING, n BIGINT, docs BIGINT"
_POINTS = "lang STRING, source STRING, term STRING, n BIGINT, ln BIGINT"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per group and term, of what a task holds at a time."""
    groups: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        whole = pa.concat_tables(held).group_by(["group", "term"], use_threads=False)
        found = whole.aggregate([("n", "sum"), ("docs", "sum")])
        return found.select(["group", "term", "n_sum", "docs_sum"]).rename_columns(["group", "term", "n", "docs"])

    def rows() -> Iterator[pa.RecordBatch]:
        names = [pa.array([key[j] for key in groups], pa.string()) for j in range(2)]
        for part in held:
            for batch in part.to_batches(max_chunksize=50_000):
                columns = [*[x.take(batch["group"]) for x in names], *[batch[c] for c in ("term", "n", "docs")]]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        of_doc = np.array([groups.setdefault(key, len(groups)) for key in keys], dtype=np.int32)
        flat = [(raw.as_py() or b"").translate(LETTERS).strip() for raw in batch.column(2)]
        terms = pc.ascii_split_whitespace(pa.array(flat, pa.binary()).cast(pa.string()))
        each = pa.table({"doc": pc.list_parent_indices(terms), "term": terms.flatten()}).filter(pc.field("term") != "")
        each = each.group_by(["doc", "term"], use_threads=False).aggregate([([], "count_all")])
        counts = {"group": of_doc[each["doc"].to_numpy()], "term": each["term"], "n": each["count_all"]}
        held.append(pa.table(counts | {"docs": np.ones(len(each), dtype=np.int64)}))
        if sum(map(len, held)) > HELD:
            held = [summed()]
            if len(held[0]) > HELD // 2:
                yield from rows()
                held, groups = [], {}
    if held:
        held = [summed()]
        yield from rows()


def _named(docs: DataFrame, lang_col: str, source_col: str) -> list[Column]:
    return [
        F.coalesce(F.col(f"`{lang_col}`"), F.lit("")).alias("lang"),
        F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("source"),
    ]


def kept_terms(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCUMENTS
) -> DataFrame:
    """lang, source, term, n (in the group), ln (in the language), lead (true once per lang and term).

    Only terms in at least `min_docs` documents of the language. Tasks count before they shuffle, and
    one shuffle by language and term serves the group's sums and the language's.
    """
    on_workers(docs.sparkSession)
    rows = docs.select(*_named(docs, lang_col, source_col), F.col(f"`{text_col}`").cast("string").cast("binary").alias("raw"))
    part = rows.mapInArrow(_counted, _COUNTS).repartition("lang", "term")
    each = part.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_lang = Window.partitionBy("lang", "term")
    summed = each.withColumns(
        {
            "ln": F.sum("n").over(of_lang),
            "in_docs": F.sum("docs").over(of_lang),
            "lead": F.col("source") == F.min("source").over(of_lang),
        }
    )
    return summed.filter(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "ln", "lead")


def _share(count: Column, total: Column, vocabulary: Column) -> Column:
    """Smoothed share in billionths, from 1; decimals, so that no count overflows."""
    up = (count.cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    down = total.cast("decimal(20,0)") + vocabulary.cast("decimal(20,0)")
    return (F.lit(1) + F.floor((up - up % down) / down)).cast("long")


def groups_of(docs: DataFrame, kept: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, total, lang_total, vocabulary, p0 (share of a term that the group lacks), idx (from 0 in the lang).

    Every pair of lang and source that occurs; one narrow row each.
    """
    seen = docs.select(*_named(docs, lang_col, source_col)).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.count(F.when(F.col("lead"), 1)).alias("vocabulary")
    )
    whole = seen.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    p0 = F.when(F.col("vocabulary") > 0, _share(F.lit(0), F.col("total"), F.col("vocabulary"))).otherwise(F.lit(1))
    idx = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return whole.withColumns({"p0": p0.cast("long"), "idx": idx})


class Skyband:
    """The points of a group that have fewer than `k` points above them, out of all that were added.

    A point is above another if its n is no lower, its ln no higher and its term earlier in UTF-8. Points come in the
    order n descending, ln ascending, term ascending, so whatever is above a point comes before it.
    """

    def __init__(self, k: int):
        self.k = k
        self.term, self.n, self.ln = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, term: pa.Array, n: np.ndarray, ln: np.ndarray) -> None:
        """Dropped points need not count: one with `k` points above it has `k` of them among those that are kept."""
        for lo in range(0, len(term), CHUNK):
            self._add(term[lo : lo + CHUNK], n[lo : lo + CHUNK], ln[lo : lo + CHUNK])

    def _add(self, term: pa.Array, n: np.ndarray, ln: np.ndarray) -> None:
        terms = pa.concat_arrays([self.term, term])
        rank = np.empty(len(terms), dtype=np.int64)
        rank[pc.array_sort_indices(terms).to_numpy()] = np.arange(len(terms))
        kept, own = rank[: len(self.term)], rank[len(self.term) :]
        open_ = np.flatnonzero(own <= self._limits(kept, ln))
        # Places among what is at hand instead of values: narrow numbers are quick to compare.
        level = np.unique(np.append(self.ln, ln[open_]), return_inverse=True)[1]
        kind = np.int16 if len(terms) < 2**15 else np.int64
        above = self._above(level.astype(kind), np.append(kept, own[open_]).astype(kind), len(kept))
        stay = open_[above < self.k]
        self.term = pa.concat_arrays([self.term, term.take(pa.array(stay))])
        self.n, self.ln = np.append(self.n, n[stay]), np.append(self.ln, ln[stay])

    def _limits(self, kept: np.ndarray, ln: np.ndarray) -> np.ndarray:
        """For each ln the `k`th earliest term of the kept points with no higher ln: a later term has `k` above it."""
        order = np.argsort(self.ln, kind="stable")
        limits = np.full(len(order) + 1, np.iinfo(np.int64).max)
        first: list[int] = []  # the k earliest terms so far, the latest of them on top
        for i, r in enumerate(kept[order].tolist(), 1):
            if len(first) < self.k:
                heapq.heappush(first, -r)
            elif -r > first[0]:
                heapq.heapreplace(first, -r)
            if len(first) == self.k:
                limits[i] = -first[0]
        return limits[np.searchsorted(self.ln[order], ln, side="right")]

    @staticmethod
    def _above(ln: np.ndarray, rank: np.ndarray, start: int) -> np.ndarray:
        """For each point from `start` on, how many points before it are above it."""
        out = np.zeros(len(ln) - start, dtype=np.int64)
        for lo in range(start, len(ln), 128):
            hi = min(lo + 128, len(ln))
            above = (ln[:hi] <= ln[lo:hi, None]) & (rank[:hi] < rank[lo:hi, None])
            above[:, lo:hi] &= np.tri(hi - lo, k=-1, dtype=bool)
            out[lo - start : hi - start] = np.count_nonzero(above, axis=1)
        return out


def _ends(*columns: pa.Array) -> list[int]:
    """Ends of the runs in which all columns stay the same."""
    return sorted(set().union(*[pc.run_end_encode(c).run_ends.to_pylist() for c in columns]))


def _bands(k: int):
    """The skyband of each group in a task, from rows in the order that `Skyband` needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, band, held = None, Skyband(k), []

        def take() -> None:
            if held:
                terms = pa.concat_arrays([b.column(2) for b in held])
                n, ln = (np.concatenate([b.column(j).to_numpy() for b in held]) for j in (3, 4))
                band.add(terms, n, ln)
                held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            take()
            if len(band.term):
                names = [pa.repeat(pa.scalar(x, pa.string()), len(band.term)) for x in key]
                columns = [*names, band.term, pa.array(band.n), pa.array(band.ln)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "ln"])

        for batch in batches:
            lo = 0
            for hi in _ends(batch.column(0), batch.column(1)):
                now = (batch.column(0)[lo].as_py(), batch.column(1)[lo].as_py())
                if now != key:
                    yield from out()
                    key, band = now, Skyband(k)
                held.append(batch.slice(lo, hi - lo))
                if sum(map(len, held)) >= CHUNK:
                    take()
                lo = hi
        yield from out()

    return run


def standing_out(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item (term), value, rank: the `top` terms of each group by value.

    The value of a term rises with its count in the group and falls with that in the language, so a
    term with `top` others above it in both, earlier in UTF-8 at ties, is in no answer. Each partition keeps
    the skyband of a group, skybands are merged in a tree, and only what is left is ranked by exact values.
    """
    order = ["lang", "source", F.col("n").desc(), "ln", "term"]

    def bands(rows: DataFrame) -> DataFrame:
        return rows.sortWithinPartitions(*order).select("lang", "source", "term", "n", "ln").mapInArrow(_bands(top), _POINTS)

    merged = bands(kept.select("lang", "source", "term", "n", "ln"))
    parts = kept.rdd.getNumPartitions()
    while parts > FAN:
        parts = -(-parts // FAN)
        salted = merged.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(parts)))
        merged = bands(salted.repartition("lang", "source", "salt"))
    merged = bands(merged.repartition("lang", "source"))
    shares = merged.join(groups, ["lang", "source"]).withColumns(
        {
            "p": _share(F.col("n"), F.col("total"), F.col("vocabulary")),
            "q": _share(F.col("ln"), F.col("lang_total"), F.col("vocabulary")),
        }
    )
    valued = shares.filter("p > q").withColumn("value", F.expr("(p - q) * (p - q) div q"))
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term")
    ranked = valued.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    return ranked.select("lang", "source", F.col("term").alias("item"), "value", "rank")


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """What the terms of one tile add to the value of each pair of its sources.

    Rows without a term are the sources themselves. Terms that no source of the tile has are
    counted by the first tile, which takes all of the vocabulary at the shares of absent terms.
    """
    none = rows["term"].isna().to_numpy()
    own = rows[none].sort_values("idx")
    idx, p0 = own["idx"].to_numpy(), own["p"].to_numpy(dtype=np.int64)
    block = own["mine"].to_numpy()
    codes, names = pd.factorize(rows["term"][~none])
    shares = np.repeat(p0[:, None], max(len(names), 1), axis=1)
    if len(names):
        shares[np.searchsorted(idx, rows["idx"][~none].to_numpy()), codes] = rows["p"][~none].to_numpy(dtype=np.int64)
    low, high, bucket = rows["low"].iloc[0], rows["high"].iloc[0], rows["bucket"].iloc[0]
    left = rows["vocabulary"].iloc[0] * (bucket == 0) - len(names)
    found = []
    for g in range(len(idx)):
        others = np.flatnonzero(block == (high if block[g] == low else low))
        apart = p0[g] - p0[others]
        value = left * (apart * apart // p0[others])
        if len(names):
            apart = shares[g] - shares[others]
            value = value + (apart * apart // shares[others]).sum(axis=1)
        found.append((np.repeat(idx[g], len(others)), idx[others], value))
    g, h, value = (np.concatenate([x[j] for x in found]) for j in range(3))
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]] * len(g), "g": g, "h": h, "value": value})


def source_distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the lang), value, rank: all pairs, as the answer asks for all of them.

    Terms are dealt to tiles by hash and sources to blocks by number; a tile holds a bounded number of
    both, and only sums per pair of sources leave it.
    """
    blocks = F.ceil((F.max("idx").over(Window.partitionBy("lang")) + 1) / F.lit(TILE_SOURCES)).cast("int")
    sized = groups.withColumns(
        {
            "blocks": blocks,
            "mine": F.floor(F.col("idx") / F.lit(TILE_SOURCES)).cast("int"),
            "buckets": F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / F.lit(TILE_TERMS))).cast("int"),
        }
    )
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cols = ["lang", "bucket", "blocks", "mine", "idx", "vocabulary", "term", "p"]
    bases = sized.withColumns(
        {"bucket": F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)), "term": F.lit(None).cast("string"), "p": F.col("p0")}
    )
    found = kept.join(sized, ["lang", "source"]).withColumns(
        {
            "bucket": F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int"),
            "p": _share(F.col("n"), F.col("total"), F.col("vocabulary")),
        }
    )
    dealt = bases.select(*cols).unionByName(found.select(*cols)).select("*", others).drop("blocks")
    tiles = dealt.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")}).drop("other")
    parts = tiles.groupBy("lang", "bucket", "low", "high").applyInPandas(_tile, "lang STRING, g BIGINT, h BIGINT, value BIGINT")
    sums = parts.filter("g <> h").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    one = groups.select("lang", F.col("idx").cast("long").alias("g"), "source")
    two = groups.select("lang", F.col("idx").cast("long").alias("h"), F.col("source").alias("item"))
    named = sums.join(one, ["lang", "g"]).join(two, ["lang", "h"])
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return named.select("lang", "source", "item", "value", F.row_number().over(by).alias("rank"))


def audit_sources(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    min_docs: int = MIN_DOCUMENTS,
    top: int = TOP,
) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) group of `docs`.

    Each row of `docs` is a document, repeated rows and ids too; nulls in text, lang or source count as ''.
    A group without terms is held against the others all the same; without any kept term in a
    language all its values are 0 and there are no `term` rows. Ties go to the item earlier in UTF-8. Very
    long texts are counted in pieces. Other columns of `docs` are ignored, whatever their names; no rows give
    no rows.
    """
    kept = settle(kept_terms(docs, lang_col, source_col, text_col, min_docs), "kept_terms")
    groups = settle(groups_of(docs, kept, lang_col, source_col), "source_groups")
    pairs = source_distances(kept, groups).withColumn("part", F.lit("pair"))
    terms = standing_out(kept, groups, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op13_source_audit(spark, sf_dir: str) -> DataFrame:
    """Divergence of all sources of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text")
    return audit_sources(docs)


SQL_OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), tok AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS ln FROM tok GROUP BY ALL HAVING count(DISTINCT r) >= 3
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(ln)::HUGEINT AS nl FROM kept GROUP BY lang
), counts AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM tok t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL
), sums AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL
), grp AS (
  SELECT g.lang, g.source, coalesce(s.total, 0) AS total, coalesce(l.v, 0) AS v, coalesce(l.nl, 0) AS nl
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN sums s ON g.lang = s.lang AND g.source = s.source
    LEFT JOIN langs l ON g.lang = l.lang
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p,
    1 + (1000000000::HUGEINT * (k.ln + 1)) // (g.nl + g.v) AS q
  FROM grp g JOIN kept k ON g.lang = k.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), two AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(t.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN two t ON t.lang = a.lang AND t.source = a.source AND t.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
