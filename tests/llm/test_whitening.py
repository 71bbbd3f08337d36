"""Whitening against plain numpy over all rows."""

import math

import numpy as np
import pytest
from corpusforge.llm import whitening
from corpusforge.llm.queries import op13_whitening
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def quantised(c):
    return None if c is None or any(v is None or not math.isfinite(v) for v in c) else [math.floor(1024 * v) + 100000 for v in c]


def plain(rows, components=8):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} over all rows, each on its own."""
    rows = [(k, quantised(c)) for k, c in rows]
    rows = [(k, x) for k, x in rows if x is not None]
    n, total = len(rows), [sum(c) for c in zip(*(x for _, x in rows), strict=True)]
    y = np.array([[(n * a - s) / n for a, s in zip(x, total, strict=True)] for _, x in rows])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for (k, x), row in zip(rows, y, strict=True):
        for i in range(min(components, len(total))):
            out[k, i + 1] = (n, sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True)), abs(row @ vectors[:, i]) / math.sqrt(values[i]), values[i] / values.sum())
    return out


def check(got, want):
    assert {(r["vec_id"], r["component"]) for r in got} == set(want)
    for r in got:
        n, deviation, whitened, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation) and r["identity_error"] < 1e-9
        assert abs(r["whitened"]) == pytest.approx(whitened, abs=1e-6) and r["explained"] == pytest.approx(explained, rel=1e-9)


def of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("*", whitening.quantised(F.col("embedding"), 1024, 100000).alias("x"), F.lit(1).alias("count"),
                                                      F.lit(2).alias("digest"), F.lit(3).alias("a.b"))


def test_query(spark):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check(op13_whitening(spark, SMALL).collect(), plain(table))


def test_copies_nulls_and_odd_entries(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in np.float32(rng.normal(size=5))]) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(60)] + [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [math.nan] * 5),
                                                          (203, [math.inf, 0.0, 0.0, 0.0, 0.0]), (None, rows[1][1])]
    check(whitening.whiten(of(spark, rows)).collect(), plain(rows))


def test_heavy_and_light_vectors_meet_their_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "HEAVY", 4)
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in np.float32(rng.normal(size=3))]) for i in range(30)]
    rows += [(50 + i, rows[i % 2][1]) for i in range(60)]
    check(whitening.whiten(of(spark, rows)).collect(), plain(rows))


def test_weights_of_one(spark):
    rows = [(i, [float(v), float(v * v % 7), 1.5 * (v % 3)]) for i, v in enumerate([1, 2, 3, 4, 5, 5, 5, 5, 1])]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(of(spark, rows), weights="one").collect()}
    want = plain(rows[:5])
    assert len(got) == 27
    for k, (n, deviation, whitened, _) in want.items():
        assert (got[k]["n"], got[k]["deviation"]) == (n, deviation) and abs(got[k]["whitened"]) == pytest.approx(whitened, abs=1e-9)
    with pytest.raises(ValueError):
        whitening.whiten(of(spark, rows), weights="some")


def test_without_variance_and_without_rows(spark):
    same = whitening.whiten(of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in same)
    flat = whitening.whiten(of(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])).orderBy("vec_id", "component").collect()
    assert [r["whitened"] is None for r in flat] == [False, True] * 2 and abs(flat[0]["whitened"]) == pytest.approx(1.0)
    assert whitening.whiten(of(spark, [])).count() == whitening.whiten(of(spark, [(1, None), (2, [])])).count() == 0


def test_other_lengths_and_great_entries(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 5.0]), (3, [0.5, 1.0]), (4, [1.0]), (5, [1e30, 1.0]), (6, [])]
    got = whitening.whiten(of(spark, rows)).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3}
    wide = whitening.whiten(of(spark, [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [2e12, 5.0])])).collect()
    assert len(wide) == 6 and all(r["deviation"] is None for r in wide)  # beyond a long
