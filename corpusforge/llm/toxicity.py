"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams (over UTF-8 bytes of the lower-cased text) that occur in it.
Each feature's value is its log-count ratio between toxic and other texts; a ridge logistic regression learns the
weights on top. The sample that is learnt from is bounded (``PER_CLASS`` labelled texts of each class, in a seeded
order). Spark tasks extract and count its n-grams; the driver receives the counts of at most 2**BITS features, and
then, for each sampled text, the few features that tell the classes apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.llm.common import labelled_sample, map_rows, written

PER_CLASS = 3000
ORDERS = (5, 6)
BITS = 20
#: A feature is learnt from if it occurs in so many sampled texts and its rates differ by so many standard errors.
LEAST_TEXTS, LEAST_Z = 4, 4.0
RIDGE, STEPS, RATE = 1e-3, 100, 0.05
PRIME, GOLDEN = np.uint32(16777619), np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Model:
    place: np.ndarray  # for each hashed feature, its place among the weighted ones, or -1
    weights: np.ndarray
    intercept: float

    def log_odds(self, text: str | None, seen: np.ndarray) -> float:
        """Intercept and weights of the text's distinct features; ``seen`` is a scratch array as long as the weights,
        False before and after."""
        found = self.place[hashed(text)]
        found = found[found >= 0]
        seen[found] = True
        total = float(self.weights[seen].sum())
        seen[found] = False
        return self.intercept + total


def prior_only(log_odds: float) -> Model:
    return Model(np.full(1 << BITS, -1, np.int32), np.zeros(0), log_odds)


def hashed(text: str | None) -> np.ndarray:
    """Hashed n-grams of the whole text, repeats included."""
    data = np.frombuffer(f" {(text or '').lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    rolled, out = data, [np.zeros(0, np.uint32)]
    for n in range(2, max(ORDERS) + 1):
        if len(data) < n:
            break
        rolled = (rolled[:-1] * PRIME) ^ data[n - 1:]
        if n in ORDERS:
            out.append(((rolled + np.uint32(n)) * GOLDEN) >> np.uint32(32 - BITS))
    return np.concatenate(out)


def features(text: str | None) -> np.ndarray:
    """Sorted numbers of the distinct hashed n-grams of the whole text."""
    return np.unique(hashed(text))


def telling(with1: np.ndarray, with0: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the counted features whose rates differ beyond chance, and their log-count ratios."""
    ratio = np.log(((with1 + 1) / (n1 + 2)) / ((with0 + 1) / (n0 + 2)))
    rate = (with1 + with0) / (n1 + n0)
    error = np.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0)) + 1e-9
    used = np.flatnonzero((np.abs(with1 / n1 - with0 / n0) > LEAST_Z * error) & (with1 + with0 >= LEAST_TEXTS))
    return used, ratio[used]


def weigh(column: np.ndarray, rows: np.ndarray, toxic: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Logistic weights (the last is the intercept) of the features with these ratios; text ``rows[i]`` has feature
    ``column[i]``."""
    y, value = toxic.astype(float), ratio[column]
    w = np.zeros(len(ratio) + 1)
    mean, spread = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = np.clip(np.bincount(rows, value * w[column], len(y)) + w[-1], -30, 30)
        miss = (1 / (1 + np.exp(-z)) - y) / len(y)
        slope = np.append(np.bincount(column, value * miss[rows], len(ratio)) + RIDGE * w[:-1], miss.sum())
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, keep: Column, per_class: int = PER_CLASS, seed: str = "toxicity") -> Model:
    """The model learnt from at most ``2 * per_class`` of the labels (column ``toxic``) that ``keep`` admits; how
    common the label is comes from all of them. Without a text of one class the model answers the prior."""
    shares = labels.where(keep & F.col("toxic").isin(0, 1)).agg(F.count_if(F.col("toxic") == 1).alias("one"), F.count("*").alias("all")).first()
    prior = math.log((shares["one"] + 1) / (shares["all"] - shares["one"] + 1))
    sample = written(labelled_sample(docs, labels, "toxic", keep, per_class, seed).select("rank", "doc_id", "label", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for label, text in zip(batch.column(2).to_pylist(), batch.column(3)):
                counts[label, features(text.as_py())] += 1
        found = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[1, found]), pa.array(counts[0, found])], ["feature", "with1", "with0"])

    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return prior_only(prior)
    counted = (sample.mapInArrow(count, "feature long, with1 long, with0 long").groupBy("feature")
               .agg(F.sum("with1").alias("with1"), F.sum("with0").alias("with0"))
               .where(F.col("with1") + F.col("with0") >= LEAST_TEXTS).toArrow().sort_by("feature"))
    used, ratio = telling(counted["with1"].to_numpy(), counted["with0"].to_numpy(), size[1], size[0])
    place = np.full(1 << BITS, -1, np.int32)
    place[counted["feature"].to_numpy()[used]] = np.arange(len(used))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shared.value[features(t.as_py())] for t in batch.column(3)]
            lists = pa.array([x[x >= 0] for x in own], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["rank", "doc_id", "label", "found"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(mark, f"rank string, doc_id {kind}, label int, found array<int>").toArrow().sort_by([("rank", "ascending"), ("doc_id", "ascending")])
    found = rows["found"].combine_chunks()
    sizes = np.diff(found.offsets.to_numpy())
    w = weigh(found.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes), rows["label"].to_numpy(), ratio)
    return Model(place, ratio * w[:-1], float(w[-1] + prior - math.log(size[1] / size[0])))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` (an own column of that name is replaced): 0 to 1, higher where the label is
    likelier.

    Whole texts are read in place and rows pass through whole; nothing is shuffled or joined, and memory is one
    Arrow batch and the model. Null and empty texts have no n-gram and take the score of the
    intercept; repeated rows and null keys stay rows of their own; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == text else f"`{c}`" for c in docs.columns if c != "score"))
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        seen = np.zeros(len(m.weights), bool)
        for batch in batches:
            z = np.array([m.log_odds(t.as_py(), seen) for t in batch.column(at)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))],
                                             [*batch.schema.names, "score"])

    return map_rows(kept, run, T.StructField("score", T.DoubleType()))
