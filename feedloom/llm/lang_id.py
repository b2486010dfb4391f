"""Language of a text: averaged hashed subword embeddings with a linear softmax.

A text is its words, lower case in A-Z, between spaces; its subwords are the runs of two to four
bytes within a word, the spaces at its ends included. Subwords share a table of embeddings by hash;
the mean of a text's embeddings goes through a linear layer and a softmax. A part of the sampled texts is kept
from training: it sets the temperature, so that scores are shares of right answers, and the score
below which an answer is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import on_workers, seeded
from feedloom.llm.terms import LETTERS

#: Production parameters. At most so many texts are learned from, dealt evenly among the languages.
SAMPLE = 6000
FOLDS, HELD_OUT = 4, 2
BUCKETS = 1 << 14
WIDTH = 16
#: Texts that descent goes through in all, the same text again where there are fewer.
STEPS = 24_000
RATE = 0.5
#: One text in so many sets the temperature and the least score.
CALIBRATING = 5
#: Share of right answers that accepted answers must reach.
TARGET = 0.99
SEED = 7
UNKNOWN = "und"

#: Bytes of a text that are hashed at once.
STRIDE = 1 << 16


def subword_counts(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket is hit by a subword of the whole text."""
    counts = np.zeros(buckets, dtype=np.int64)
    words = (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()
    if not words:
        return counts
    flat = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8)
    for lo in range(0, len(flat), STRIDE):
        # Three bytes more, so that no subword is lost at the seam; each begins in one piece only.
        part = flat[lo : lo + STRIDE + 3].astype(np.uint32)
        blank = part == 32
        hashed = part + np.uint32(1)
        inner = np.zeros(len(part), dtype=bool)
        for size in (2, 3, 4):
            m = len(part) - size + 1
            if m <= 0:
                break
            hashed = hashed[:m] * np.uint32(0x01000193) + part[size - 1 :]
            # A space may open or close a subword, but not lie within.
            inner = inner[:m] | (blank[size - 2 : size - 2 + m] if size > 2 else False)
            begins = np.arange(m) < STRIDE
            mixed = hashed[~inner & begins]
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            counts += np.bincount((mixed ^ (mixed >> np.uint32(13))) % np.uint32(buckets), minlength=buckets)
    return counts


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(counts)
        if not len(at):
            return self.bias
        share = counts[at] / counts[at].sum()
        return (share @ self.table[at]) @ self.weights + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its calibrated score; `UNKNOWN` and 0 for a text without letters."""
        if not self.langs or not any(map(str.isalpha, text or "")):
            return UNKNOWN, 0.0
        shares = _softmax(self.logits(subword_counts(text, len(self.table))) / self.temperature)
        best = int(shares.argmax())
        return self.langs[best], float(shares[best])


def fit_embeddings(
    texts: list[tuple[np.ndarray, np.ndarray]], answers: np.ndarray, langs: list[str], buckets: int = BUCKETS,
    width: int = WIDTH, steps: int = STEPS, rate: float = RATE, seed: int = SEED,
) -> Model:
    """Plain stochastic gradient descent, one text at a time, the rate falling to nothing.

    `texts`: buckets that are hit and the share of each. The table begins at random, the layer at zero.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1, 1, (buckets, width)) / width
    weights, bias = np.zeros((width, len(langs))), np.zeros(len(langs))
    epochs, step = -(-steps // max(len(texts), 1)), 0
    steps = epochs * len(texts)
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            at, share = texts[i]
            mean = share @ table[at]
            off = _softmax(mean @ weights + bias)
            off[answers[i]] -= 1.0
            now = rate * (1 - step / steps)
            back = weights @ off
            weights -= now * np.outer(mean, off)
            bias -= now * 0.1 * off
            # Each subword moves in full, as its share of the mean would make it crawl.
            table[at] -= now * np.outer(np.sqrt(share), back)
            step += 1
    return Model(langs, table, weights, bias)


def calibrate(model: Model, logits: np.ndarray, answers: np.ndarray, target: float = TARGET) -> Model:
    """Temperature of least log loss, and the least score at which accepted answers are right often enough.

    Answers are smoothed as if each language had one more text, so that a model without a fault on the
    texts at hand is not taken for certain. Without texts to calibrate by, scores stay as they are and nothing is
    rejected.
    """
    if not len(answers):
        return model
    kinds = max(len(model.langs), 2)
    aims = np.full(logits.shape, 1.0 / (len(answers) + kinds))
    aims[np.arange(len(answers)), answers] += len(answers) / (len(answers) + kinds)

    def loss(t: float) -> float:
        return -(aims * np.log(np.maximum(_softmax(logits / t), 1e-300))).sum(axis=1).mean()

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    best = float(grid[int(np.argmin([loss(t) for t in grid]))])
    shares = _softmax(logits / best)
    top, right = shares.max(axis=1), shares.argmax(axis=1) == answers
    order = np.argsort(-top, kind="stable")
    # Only the last of equal scores can be a limit.
    ends = np.append(top[order][1:] != top[order][:-1], True)
    good = ends & (np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= target)
    least = 0.0 if good[-1] else float(top[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return Model(model.langs, model.table, model.weights, model.bias, best, least)


def fold(id_col: str = "doc_id") -> Column:
    """Remainder of the CRC of the id as text; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(FOLDS)), F.lit(HELD_OUT))


def train(
    docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **settings
) -> Model:
    """Learn from texts outside the held-out fold whose language is given: at most `sample` of them.

    The sample is dealt evenly among the languages and takes the rows with the least hashes of id and text,
    so any layout gives the same (of a share of the hashes that holds twice as many rows by expectation). More than `sample` languages leave one text for each of the commonest.
    """
    on_workers(docs.sparkSession)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
        F.col(f"`{lang_col}`").alias("lang"), fold(id_col).alias("fold"),
    ).filter((F.col("fold") != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    common = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(sample)
    sizes = {r["lang"]: r["n"] for r in common.collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((1, 1)), np.zeros((1, 0)), np.zeros(0))
    each = max(1, sample // len(langs))
    # One row per learned language, `sample` at most, so no texts are moved to find the sample.
    cuts = docs.sparkSession.createDataFrame([(x, 2.0 * each / sizes[x]) for x in langs], "lang STRING, cut DOUBLE")
    chance = seeded("lang sample", F.col("id").cast("string"), F.xxhash64("text"))
    low = rows.withColumn("chance", chance).join(F.broadcast(cuts), "lang").filter(F.col("chance") / F.lit(2.0**64) + 0.5 <= F.col("cut"))
    # Twice as many narrow rows as are wanted are ranked, however common the language is.
    drawn = low.select("lang", "id", "chance").withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy("chance", "id")))
    last = drawn.filter(F.col("turn") <= each).groupBy("lang").agg(F.max("chance").alias("last"))
    chosen = low.join(F.broadcast(last), "lang").filter("chance <= last")

    @F.pandas_udf("at binary, n binary")
    def packed(column: pd.Series) -> pd.DataFrame:
        found = [subword_counts(t) for t in column]
        at = [np.flatnonzero(c).astype(np.uint16) for c in found]
        return pd.DataFrame(
            {"at": [a.tobytes() for a in at], "n": [c[a].astype(np.uint32).tobytes() for c, a in zip(found, at)]}
        )

    # Equal rows share a chance; one of each is enough, and the bound holds.
    once = chosen.select("lang", "chance", packed("text").alias("x")).groupBy("lang", "chance").agg(F.min("x").alias("x"))
    found = sorted(once.collect(), key=lambda r: (r["chance"], r["lang"]))
    texts, answers = [], []
    for r in found:
        n = np.frombuffer(r["x"]["n"], dtype=np.uint32).astype(np.float64)
        if len(n):
            texts.append((np.frombuffer(r["x"]["at"], dtype=np.uint16).astype(np.int64), n / n.sum()))
            answers.append(langs.index(r["lang"]))
    answers = np.array(answers, dtype=np.int64)
    spare = np.arange(len(texts)) % CALIBRATING == CALIBRATING - 1
    learned = [t for t, s in zip(texts, spare) if not s]
    model = fit_embeddings(learned, answers[~spare], langs, **settings)
    logits = [(s @ model.table[at]) @ model.weights + model.bias for (at, s), x in zip(texts, spare) if x]
    return calibrate(model, np.array(logits).reshape(-1, len(langs)), answers[spare])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred, lang_score and lang_rejected for each whole text.

    A null text, or one without any letter, is `und` with score 0 and rejected. Every other text has the likeliest
    learned language; it is rejected where its score is below what calibration asks for. A model that has
    learned nothing answers `und`. Only the text decides: equal texts have equal answers. Very long texts are
    hashed in pieces. Columns of `docs` with these three names are replaced.
    """
    on_workers(docs.sparkSession)

    @F.pandas_udf("lang string, score double")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            found = [model.predict(t) for t in column]
            yield pd.DataFrame({"lang": [x[0] for x in found], "score": [x[1] for x in found]}).astype({"score": "float64"})

    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score", "lang_rejected")]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    judged = held.withColumn("_found", answer(F.col("_doc")[text_col].cast("string")))
    lang, score = F.col("_found")["lang"], F.col("_found")["score"]
    return judged.select(
        *[F.col("_doc")[c].alias(c) for c in own],
        lang.alias("lang_pred"),
        score.alias("lang_score"),
        ((lang == UNKNOWN) & (score == 0) | (score < model.least)).alias("lang_rejected"),
    )


def op11_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return found.select(
        "doc_id",
        (fold() == HELD_OUT).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"),
    )
