"""Ranked lexical search: the best documents for each of a stated set of items.

Documents are dealt to tasks, and every task answers all items of a block on its own documents, term at
a time and the rarest term first. Once the terms that are left cannot lift a new document to the
kth partial score, no further accumulators are made; those that exist are updated to their exact scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm.common import on_workers
from feedloom.llm.terms import LETTERS_AND_DIGITS, term_lists
from feedloom.session import settle

#: Production parameters: documents per item, and the constants of the score.
TOP = 20
FLAT, SLOPE, SATURATION = 75, 25, 12
UNIT = 1_000_000_000

#: Bytes of terms of the items that are searched for at once; this much goes to every task.
BLOCK_BYTES = 4_000_000
#: Postings that a task turns into lists at once.
SEGMENT = 1_000_000


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of each item and how often it has them."""
    for batch in batches:
        terms, times = [], []
        for raw in batch.column(1):
            found: Counter = Counter()
            for part in term_lists(raw.as_py(), LETTERS_AND_DIGITS):
                found.update(part)
            terms.append(list(found))
            times.append(list(found.values()))
        columns = [batch.column(0), pa.array(terms, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["item", "terms", "times"])


def _postings(vocabulary: dict[bytes, int]):
    """Number of terms of each document, and those that some item asks for with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = vocabulary.keys()
        for batch in batches:
            lengths, ids, times, ends = [], [], [], [0]
            for raw in batch.column(1):
                found: Counter = Counter()
                for part in term_lists(raw.as_py(), LETTERS_AND_DIGITS):
                    found.update(part)
                lengths.append(found.total())
                shared = found.keys() & wanted
                ids.extend(vocabulary[t] for t in shared)
                times.extend(found[t] for t in shared)
                ends.append(len(ids))
            at = pa.array(ends, pa.int32())
            columns = [
                batch.column(0),
                pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())),
                pa.ListArray.from_arrays(at, pa.array(times, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "ids", "times"])

    return run


@dataclass
class Item:
    """An item's terms, the rarest first, and what one part of a term's score counts for it."""

    key: int
    ids: list[int]
    weights: list[int]


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Segment:
    """Postings of some documents by term: places of documents and the term's part of their scores."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, ids: np.ndarray, times: np.ndarray, n_docs: int, total: int):
        self.docs = len(n)
        place = np.repeat(np.arange(len(n)), sizes)
        m = FLAT + (SLOPE * n * n_docs) // max(total, 1)
        part = (UNIT * times) // (1000 * times + SATURATION * m[place])
        order = np.argsort(ids, kind="stable")
        self.places, self.parts = place[order], part[order]
        self.terms, starts = np.unique(ids[order], return_index=True)
        self.ends = np.append(starts, len(order))
        self.most = np.maximum.reduceat(self.parts, starts) if len(starts) else np.zeros(0, dtype=np.int64)
        self.scores = np.zeros(self.docs, dtype=np.int64)

    def lists_of(self, item: Item) -> list[tuple[int, int]]:
        """(number of the term's list here, weight) of the terms that occur here, in the item's order."""
        at = np.searchsorted(self.terms, item.ids)
        return [
            (int(j), w)
            for j, i, w in zip(at, item.ids, item.weights)
            if j < len(self.terms) and self.terms[j] == i
        ]

    def search(self, item: Item, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of all documents here that can be among the best `k`.

        `least`: a score that `k` other documents are known to reach; documents below it are not needed.
        """
        lists = self.lists_of(item)
        bounds = np.array([w * int(self.most[j]) for j, w in lists], dtype=np.int64)
        left = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        scores, survivors, made = self.scores, None, 0
        for step, (j, weight) in enumerate(lists):
            lo, hi = self.ends[j], self.ends[j + 1]
            places, gains = self.places[lo:hi], self.parts[lo:hi] * weight
            # A new document could still tie with the kth one and have the smaller id, so only less will do.
            if survivors is None and left[step] < least:
                survivors = np.flatnonzero(scores)
            if survivors is None:
                scores[places] += gains
                made += len(places)
                if made >= k:
                    held = scores[places] if len(places) >= k else scores[scores > 0]
                    if len(held) >= k:
                        least = max(least, int(np.partition(held, len(held) - k)[len(held) - k]))
            elif len(survivors):
                at = np.searchsorted(places, survivors)
                at[at == len(places)] = 0
                hit = places[at] == survivors
                scores[survivors[hit]] += gains[at[hit]]
        found = survivors if survivors is not None else np.flatnonzero(scores)
        exact = scores[found]
        scores[found] = 0
        good = exact >= max(least, 1)
        return found[good], exact[good]


def _best_of(items: list[Item], n_docs: int, total: int, k: int, segment: int = SEGMENT):
    """The best `k` documents of a task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        held: list[pa.RecordBatch] = []

        def answer() -> None:
            n = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in held])
            sizes = np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in held])
            ids = np.concatenate([b.column(2).flatten().to_numpy() for b in held])
            times = np.concatenate([b.column(3).flatten().to_numpy() for b in held])
            docs = pa.chunked_array([b.column(0) for b in held])
            part = Segment(n, sizes, ids, times, n_docs, total)
            for item in items:
                known = best.get(item.key, [])
                places, scores = part.search(item, k, known[-1][0] if len(known) == k else 0)
                if len(places):
                    new = zip(scores.tolist(), docs.take(pa.array(places)).to_pylist())
                    best[item.key] = sorted([*known, *new], key=lambda x: (-x[0], x[1] is None, x[1]))[:k]

        waiting, kind = 0, None
        for batch in batches:
            kind = batch.column(0).type
            if len(batch):
                held.append(batch)
                waiting += len(batch.column(2).flatten())
            if waiting >= segment:
                answer()
                held, waiting = [], 0
        if held:
            answer()
        rows = [(key, doc, score) for key, found in best.items() for score, doc in found]
        if rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), kind, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc", "score"])

    return run


def _block(docs: DataFrame, queries: list, k: int) -> DataFrame:
    """item, doc, score of the best documents of every task for one block of items."""
    df_type = docs.schema["doc"].dataType.simpleString()
    vocabulary: dict[bytes, int] = {}
    for q in queries:
        for term in q["terms"]:
            vocabulary.setdefault(bytes(term), len(vocabulary))
    index = settle(
        docs.mapInArrow(_postings(vocabulary), f"doc {df_type}, n BIGINT, ids ARRAY<INT>, times ARRAY<BIGINT>").filter("n > 0"),
        "postings",
    )
    totals = index.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    # One row per term of the block, which is bounded.
    counted = index.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).collect()
    df = {r["id"]: r["df"] for r in counted}
    items = []
    for q in queries:
        terms = [(vocabulary[bytes(t)], n) for t, n in zip(q["terms"], q["times"]) if vocabulary[bytes(t)] in df]
        terms.sort(key=lambda x: (df[x[0]], x[0]))
        weights = [n * term_weight(totals["docs"], df[i]) for i, n in terms]
        items.append(Item(q["item"], [i for i, _ in terms], weights))
    found = _best_of(items, totals["docs"], totals["terms"], k)
    return index.mapInArrow(found, f"item BIGINT, doc {df_type}, score BIGINT")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: the `k` best rows of `docs` for each row of `items`.

    A row of `items` is an item, also where its id repeats or is null; each row of `docs` is a document. Null
    and empty texts have no terms: as items they have no rows, as documents they do not count. Equal scores go by
    ascending id, null ids last. Very long texts are read in pieces. Items are searched for in blocks of about
    `block_bytes` bytes of terms, each against all documents. Other columns are ignored; no items or
    no documents give no rows.
    """
    spark: SparkSession = docs.sparkSession
    on_workers(spark)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("raw"))
    named = settle(
        items.select(
            F.monotonically_increasing_id().alias("item"),
            F.col(f"`{item_col}`").alias("item_id"),
            F.col(f"`{item_text_col}`").cast("string").cast("binary").alias("raw"),
        ),
        "items",
    )
    asked = settle(
        named.select("item", "raw").mapInArrow(_term_rows, "item BIGINT, terms ARRAY<BINARY>, times ARRAY<BIGINT>"), "item_terms"
    )
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 16)
    whole = asked.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = max(1, -(-whole // block_bytes))
    answers = None
    for b in range(blocks):
        queries = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).filter(F.size("terms") > 0)
        part = _block(texts, sorted(queries.collect(), key=lambda r: r["item"]), k)
        answers = part if answers is None else answers.unionByName(part)
    by = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = answers.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.join(named.select("item", "item_id"), "item").select(
        "item_id", "rank", F.col("doc").alias("doc_id"), "score"
    )


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """All documents ranked for each benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


SQL_OP12 = r"""
WITH tok AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, * FROM documents)
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL
), tf AS (
  SELECT r, doc_id, term, count(*) AS tf FROM tok GROUP BY ALL
), lengths AS (
  SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r
), totals AS (
  SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM lengths
), weights AS (
  SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, nd
), scored AS (
  SELECT a.item_id, t.r, t.doc_id,
    sum(a.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (75 + (25 * n.n * s.nd) // s.l))))::BIGINT AS score
  FROM asked a JOIN weights w ON a.term = w.term JOIN tf t ON t.term = a.term JOIN lengths n ON n.r = t.r, totals s
  GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
