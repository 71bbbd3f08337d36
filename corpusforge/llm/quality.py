"""Quality by compression: which of two zstandard dictionaries, of good or of bad text, shortens a text more.

The dictionaries are trained on a bounded, seeded sample of the labelled texts, which are read whole, both in the same way
and to the same size. A text's only feature is the difference of its compressed sizes with the bad and the good
dictionary, over their sum; a logistic curve fitted on labelled texts that built no dictionary turns it into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import labelled_sample

#: Labelled texts of each class that are used: two in three build a dictionary, the others calibrate.
PER_CLASS = 2000
#: Bytes of labelled texts of a class that are used, so what reaches the driver is bounded: whole texts in the seeded
#: order while they fit, none of more than LONGEST bytes.
CLASS_BYTES, LONGEST = 16 * 1024 * 1024, 1024 * 1024
DICT_BYTES = 512 * 1024
#: Training sees a text as pieces of at most so many bytes, and picks segments of about ``SEGMENT`` bytes from all over
#: the texts, those with the substrings of ``GRAM`` bytes that most pieces share.
PIECE, SEGMENT, GRAM = 16 * 1024, 256, 8
LEVEL = 6
#: Texts are compressed in chunks of so many bytes, so that the whole dictionary stays inside the window for each.
CHUNK = 256 * 1024


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    shift: float


class Compressors:
    """The two dictionaries, digested once for each task."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)  # trained, or raw: no text begins with the magic number
            d.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False))

    def difference(self, text: str | None) -> float:
        """Compressed size with the bad dictionary less that with the good one, over their sum; 0 for an empty text."""
        data = (text or "").encode("utf-8", "replace")
        if not data:
            return 0.0
        good, bad = (sum(len(c.compress(data[i:i + CHUNK])) for i in range(0, len(data), CHUNK)) for c in self.pair)
        return (bad - good) / (good + bad)


def dictionaries(good: list[str], bad: list[str]) -> tuple[bytes, bytes]:
    """A dictionary of each class, both of one kind and size: trained to half the bytes of the smaller class, at most
    ``DICT_BYTES``; or, where one class is too small or too alike to train on, the whole texts of both that fit there."""
    classes = [[d for t in texts if (d := t.encode("utf-8", "replace"))] for texts in (good, bad)]
    size = min(DICT_BYTES, *(sum(map(len, c)) // 2 for c in classes))
    try:
        return tuple(zstandard.train_dictionary(size, [d[i:i + PIECE] for d in c for i in range(0, len(d), PIECE)], k=SEGMENT, d=GRAM).as_bytes()
                     for c in classes)
    except (zstandard.ZstdError, ValueError):
        return tuple(raw(c, 2 * size) for c in classes)


def raw(texts: list[bytes], size: int) -> bytes:
    """Different texts one after the other, whole, each that still fits."""
    out = b" "
    for text in dict.fromkeys(texts):
        if len(out) + len(text) < size:
            out += b"\n" + text
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression, by Newton steps."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty * len(x), a.T @ (p - y) + len(x) * penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, keep: Column, per_class: int = PER_CLASS, seed: str = "quality") -> Model:
    """Dictionaries and calibration from at most ``2 * per_class`` labelled texts (label column ``quality``) of at most
    ``CLASS_BYTES`` a class.

    Classes are weighted back to their shares among all labels that ``keep`` admits, which are counted whole.
    """
    counts = {int(r["quality"]): r["n"] for r in labels.where(keep & F.col("quality").isin(0, 1)).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    sample = labelled_sample(docs, labels, "quality", keep, per_class, seed).withColumn("size", F.octet_length("text")).where(F.col("size") <= LONGEST)
    upto = Window.partitionBy("label").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # at most per_class rows
    sample = sample.withColumn("upto", F.sum("size").over(upto)).where(F.col("upto") <= CLASS_BYTES)
    rows = sorted((r["rank"], r["doc_id"], r["label"], r["text"]) for r in
                  sample.select("rank", "doc_id", "label", F.concat_ws("", "text").alias("text")).collect())
    return fit_rows([(label, text) for _, _, label, text in rows], counts)


def fit_rows(rows: list[tuple[int, str]], counts: dict[int, int]) -> Model:
    build = [r for i, r in enumerate(rows) if i % 3 != 2]
    good, bad = dictionaries(*([t for label, t in build if label == value] for value in (1, 0)))
    both = Compressors(good, bad)
    rest = [r for i, r in enumerate(rows) if i % 3 == 2 and r[1]]
    if len({label for label, _ in rest}) < 2:
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return Model(good, bad, 0.0, math.log(share / (1 - share)))
    x = np.array([[both.difference(t)] for _, t in rest])
    y = np.array([label for label, _ in rest], float)
    mean, scale = x.mean(), x.std() + 1e-9
    slope, shift = logistic((x - mean) / scale, y)
    sampled = max(y.sum(), 1) / max((1 - y).sum(), 1)
    shift += math.log(max(counts.get(1, 1), 1) / max(counts.get(0, 1), 1)) - math.log(sampled)
    return Model(good, bad, float(slope / scale), float(shift - slope * mean / scale))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row, 0 to 1, higher for good text; whole texts are compressed, nothing is shuffled.

    Null and empty texts take the score of a text that both dictionaries shorten alike; repeated and null keys stay rows of their own;
    extra columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        both = Compressors(m.good, m.bad)
        for batch in batches:
            z = np.array([m.slope * both.difference(t.as_py()) + m.shift for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["key", "score"])

    return slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)
