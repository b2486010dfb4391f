"""Quality classifier learned from positive and unlabelled texts.

Trusted positives are rows labelled 1; everything else is unlabelled, so a missing or wrong 0 cannot
mislead it. The risk is that of non-negative PU learning: prior * loss of positives as positive, plus
the loss of unlabelled texts as negative less the share that their hidden positives cause, the latter
never below zero.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import on_workers, seeded

#: Production parameters. At most so many positives and so many unlabelled texts are learned from.
SAMPLE = 6000
FOLDS = 5
THRESHOLD = 0.3
EPOCHS = 200
BATCH = 1000
RATE = 0.03
DECAY = 1e-4
SEED = 11

#: Classes of bytes: letters by case, digits, blanks, single marks, and bytes of other characters.
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_classes() -> np.ndarray:
    own = {c: i for i, c in enumerate(b"!#$%&*,-.|?", start=7)}
    table = np.zeros(256, dtype=np.int64)
    table[128:] = 1
    table[[*range(97, 123)]] = 2
    table[[*range(65, 91)]] = 3
    table[[*range(48, 58)]] = 4
    table[[9, 11, 12, 13, 32]] = 5
    table[10] = 6
    for c in _MARKS:
        table[c] = own.get(c, 18)
    return table


_CLASSES = _byte_classes()
_K = 19
#: Pairs of classes, then nine figures of the whole text.
FEATURES = _K * _K + 9


def features(text: str | None) -> np.ndarray:
    """Shares of byte class pairs (as roots) and figures on words and lines of the whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out = np.zeros(FEATURES, dtype=np.float32)
    if not len(raw):
        return out
    kinds = _CLASSES[raw]
    if len(kinds) > 1:
        pairs = np.bincount(kinds[:-1] * _K + kinds[1:], minlength=_K * _K)
        out[: _K * _K] = np.sqrt(pairs / (len(kinds) - 1))
    words = text.split()
    if words:
        lines = text.split("\n")
        n = len(words)
        out[-9] = sum(map(eq, words, words[1:])) / n
        out[-8] = sum(map(eq, words, words[2:])) / n
        out[-7] = sum(w.isupper() for w in words) / n
        out[-6] = min(1.0, np.log1p(n) / 10)
        out[-5] = len(set(words)) / n
        out[-4] = min(2.0, len(text) / n / 10)
        out[-3] = len(set(lines)) / len(lines)
        out[-2] = min(2.0, np.log1p(len(text) / len(lines)) / 5)
        out[-1] = 1.0
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def fit_nnpu(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, batch: int = BATCH,
    rate: float = RATE, decay: float = DECAY, seed: int = SEED,
) -> Model:
    """A linear model that minimises the non-negative PU risk under logistic loss.

    Without positives or unlabelled texts every score is the prior.
    """
    prior = float(np.clip(prior, 0.01, 0.99))
    size = positive.shape[1]
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    if not len(positive) or not len(unlabelled):
        return Model(w, b, prior)
    rng = np.random.default_rng(seed)
    theta = np.append(w, b)
    p = np.hstack([positive, np.ones((len(positive), 1))]).astype(np.float64)
    u = np.hstack([unlabelled, np.ones((len(unlabelled), 1))]).astype(np.float64)
    first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
    mean, taken = np.zeros_like(theta), 0

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))

    steps = max(1, -(-max(len(p), len(u)) // batch))
    for epoch in range(epochs):
        order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
        for i in range(steps):
            x = p[order_p[np.arange(i * batch, (i + 1) * batch) % len(p)]]
            y = u[order_u[np.arange(i * batch, (i + 1) * batch) % len(u)]]
            at_x, at_y = x @ theta, y @ theta
            as_positive = -(sigmoid(-at_x) @ x) / len(x)
            as_negative = (sigmoid(at_x) @ x) / len(x)
            of_unlabelled = (sigmoid(at_y) @ y) / len(y)
            hidden = np.logaddexp(0, at_y).mean() - prior * np.logaddexp(0, at_x).mean()
            if hidden >= 0:
                gradient = prior * as_positive + of_unlabelled - prior * as_negative
            else:
                # The estimate of the negatives' risk went below zero: step back from fitting it.
                gradient = prior * as_negative - of_unlabelled
            gradient = gradient + decay * np.append(theta[:-1], 0.0)
            step += 1
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        if epoch >= epochs // 2:
            mean, taken = mean + theta, taken + 1
    theta = mean / max(taken, 1) if taken else theta
    return Model(theta[:-1], float(theta[-1]), prior)


def fold(id_col: str = "doc_id") -> Column:
    """Remainder of the CRC of the id as text; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(FOLDS)), F.lit(0))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from rows whose fold is not 0: at most `sample` trusted positives and unlabelled texts.

    Samples are the rows with the least hashes of their ids, so any layout gives the same. The
    class prior is the share of label 1 among all labelled rows outside the held-out fold. An id
    labelled both ways is no trusted positive; null labels and ids are left out.
    """
    on_workers(docs.sparkSession)
    seen = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(fold() != 0)
    judged = seen.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    texts = docs.select("doc_id", "text").filter("doc_id IS NOT NULL").filter(fold() != 0)
    chance = seeded("sample", F.col("doc_id"))
    share = judged.agg(F.avg(F.col("low").cast("double"))).first()[0]

    def least(rows: DataFrame, positive: bool) -> DataFrame:
        picked = rows.select("doc_id").orderBy(chance, "doc_id").limit(sample)
        return picked.select("doc_id", F.lit(positive).alias("positive"))

    trusted = least(judged.filter("low = 1 AND high = 1").join(texts.select("doc_id"), "doc_id", "left_semi"), True)
    picked = trusted.unionByName(least(texts.select("doc_id").distinct(), False))
    # At most 2 * sample ids: small by its own limits.
    rows = texts.join(F.broadcast(picked), "doc_id")

    @F.pandas_udf("binary")
    def packed(column: pd.Series) -> pd.Series:
        return column.map(lambda t: features(t).tobytes(), na_action=None)

    # One text per id, so that no repeated id can make the sample larger.
    each = rows.select("doc_id", "positive", packed("text").alias("x")).groupBy("doc_id", "positive")
    found = sorted(each.agg(F.min("x").alias("x")).collect(), key=lambda r: r["doc_id"])

    def matrix(positive: bool) -> np.ndarray:
        parts = [np.frombuffer(r["x"], dtype=np.float32) for r in found if r["positive"] is positive]
        return np.array(parts).reshape(-1, FEATURES)

    return fit_nnpu(matrix(True), matrix(False), 0.5 if share is None else share)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 for each whole text; a null text counts as empty.

    Only the text decides. A text without words is a score like any other, from the model's bias and
    what bytes there are. A column named `score_col` is replaced.
    """
    on_workers(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype="float64")
        return pd.Series(model.scores(np.array([features(t) for t in column])))

    return docs.withColumn(score_col, scored(F.col(f"`{text_col}`").cast("string")))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score and predicted (1 if the score reaches `threshold`, else 0)."""
    scored = score(docs, train(docs, labels))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")
