"""Whitening of embeddings with the multiplicity of each distinct vector as its weight.

Identical vectors are grouped first. Each distinct vector then enters the sums, the centred product and the projection
once, weighted by its count (or by one), and the result is joined back to the rows. Sums are exact whole numbers, so
centring loses nothing to the size of the entries. What reaches the driver depends on the dimension only: the sums, the
covariance and its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import written

COMPONENTS = 8
#: A vector with more than 1/HEAVY of all rows is heavy: there are fewer than HEAVY of them, and they are broadcast.
HEAVY = 1024
#: Entries from this size on are no exact doubles; a vector that holds one counts as non-finite.
LARGEST = 1 << 52


def quantised(vector: Column, scale: float, shift: int) -> Column:
    """floor(scale * entry) + shift of every entry as long; null where the vector is null or holds an entry that is
    null, not finite or not below ``LARGEST`` after scaling."""
    scaled = F.transform(vector.cast("array<double>"), lambda e: e * F.lit(float(scale)))
    sound = F.forall(scaled, lambda e: F.coalesce(F.abs(e) < F.lit(float(LARGEST)), F.lit(False)))  # NaN is above all
    return F.when(vector.isNotNull() & sound, F.transform(scaled, lambda e: F.floor(e) + F.lit(shift).cast("long")))


def digest(x: Column) -> Column:
    """A name of 32 letters for a vector, to join by."""
    return F.md5(F.array_join(x.cast("array<string>"), ",").cast("binary"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def sums(groups: DataFrame, width: int) -> tuple[int, list[int]]:
    """Weight and weighted sum of each entry over (x, weight), exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, dtype=object)
        for batch in batches:
            if batch.num_rows:
                weight = batch.column(1).to_numpy().astype(object)
                n += int(weight.sum())
                total = total + (matrix(batch.column(0), width).astype(object) * weight[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([str(v) for v in [n, *total]])], ["i", "v"])

    parts = groups.select("x", "weight").mapInArrow(run, "i int, v string")
    found = dict(parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)"))).collect())
    return int(found.get(-1, 0)), [int(found.get(i, 0)) for i in range(width)]


def gram(groups: DataFrame, value: str, width: int, centred) -> np.ndarray:
    """Sum over (value, weight) of weight * yᵀy, y being ``centred`` of the values: a product of matrices for each
    batch, added up by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                y = centred(matrix(batch.column(0), width))
                total += (y * batch.column(1).to_numpy()[:, None]).T @ y
        at = np.arange(width * width, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "v"])

    parts = groups.select(value, "weight").mapInArrow(run, "at long, v double").where("v <> 0")
    out = np.zeros(width * width)
    for at, v in parts.groupBy("at").agg(F.sum("v")).collect():
        out[at] = v
    return out.reshape(width, width)


def centre(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - total / n: the whole part is taken off in whole numbers."""
    whole = np.array([t // n for t in total], dtype=np.int64)
    return (x - whole).astype(float) - np.array([t % n / n for t in total])


def axes(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; each vector's largest entry is positive.
    Values that are no more than rounding are zero."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    values = np.where(values > len(cov) * np.finfo(float).eps * max(values[0], 0.0), values, 0.0)
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[top, np.arange(vectors.shape[1])])


def whiten(df: DataFrame, key: str = "vec_id", x: str = "x", components: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): for every row whose vector ``x`` (array of
    long) isn't null, one row for each of the first ``components`` principal components, or of all if they are fewer.

    The fit takes every distinct vector with its count as weight, or with one (``weights="one"``); n is the sum of the
    weights, ``deviation`` the exact sum over dimensions of (n*x-S)² (null beyond a long), ``explained`` the component's
    share of the variance, ``identity_error`` the largest difference between the covariance of the whitened vectors and
    the identity. A component without variance has null ``whitened`` and takes no part in the error; ``explained`` is
    null if there is no variance at all. Vectors of another length than most vectors have (the longest of equally
    common lengths) or of length 0 can't be compared and are left out like null ones. Repeated and null keys stay rows
    of their own; no rows give no rows; further columns are ignored.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights are 'counts' or 'one'")
    rows = df.select(F.col(key).alias("key"), F.col(x).cast("array<long>").alias("x")).where("x is not null")
    groups = written(rows.groupBy("x").agg(F.count("*").alias("count"))
                     .withColumn("weight", F.col("count") if weights == "counts" else F.lit(1).cast("long")))
    lengths = groups.where("size(x) > 0").groupBy(F.size("x").alias("w")).agg(F.sum("count").alias("c"))
    common = lengths.orderBy(F.desc("c"), F.desc("w")).limit(1).collect()
    width = common[0]["w"] if common else 1
    groups = groups.where(F.size("x") == width)
    n, total = sums(groups, width)
    cov = gram(groups, "x", width, lambda v: centre(v, n, total)) / max(n, 1)
    trace = float(np.trace(cov))
    values, vectors = axes(cov, components)
    scale = np.where(values > 0, 1 / np.sqrt(np.where(values > 0, values, 1.0)), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(total, dtype=object)
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(0), width)
                away = ((v.astype(object) * n - whole) ** 2).sum(axis=1)
                w = centre(v, n, total) @ vectors * scale
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array([d if d < 1 << 63 else None for d in away], pa.int64()),
                     pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), pa.array(w.ravel()))],
                    ["x", "weight", "count", "deviation", "w"])

    done = groups.select("x", "weight", "count").mapInArrow(run, "x array<long>, weight long, count long, deviation long, w array<double>")
    done = written(done.select(digest(F.col("x")).alias("digest"), "weight", "count", "deviation", "w"))
    live = values > 0
    mean = dict(done.select("weight", F.posexplode("w")).groupBy("pos").agg(F.sum(F.col("col") * F.col("weight"))).collect())
    mean = np.array([mean.get(i, 0.0) for i in range(len(values))]) / max(n, 1)
    spread = gram(done, "w", len(values), lambda v: v - mean) / max(n, 1)
    error = float(np.abs(spread - np.eye(len(values)))[np.ix_(live, live)].max(initial=0.0))

    named = rows.where(F.size("x") == width).select("key", digest(F.col("x")).alias("digest"))
    n_rows = done.agg(F.sum("count")).first()[0] or 0
    part = done.select("digest", "deviation", "w", (F.col("count") * HEAVY > F.lit(n_rows)).alias("heavy"))
    heavy = F.broadcast(part.where("heavy").drop("heavy"))
    joined = named.join(heavy, "digest").unionByName(
        named.join(heavy.select("digest"), "digest", "left_anti").join(part.where("not heavy").drop("heavy"), "digest"))
    shares = F.array(*(F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in values))
    return joined.select("key", "deviation", F.posexplode("w").alias("pos", "w")).select(
        F.col("key").alias(key), (F.col("pos") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.get(F.array(*(F.lit(bool(v)) for v in live)), F.col("pos")), F.col("w")).alias("whitened"),
        F.get(shares, F.col("pos")).alias("explained"), F.lit(error).alias("identity_error"))

