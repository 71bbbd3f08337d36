"""Every row survives: NULL, repeated, sparse and hashed ids, at every size."""

import collections

import pytest
from corpusforge.operators import logs, ordering, sampling, subword
from corpusforge.plans import composites
from corpusforge.sources import lines
from pyspark.sql import functions as F


def odd_ids(spark, n=300):
    rows = [(i * i * 10**12 - 5 * 10**15, i) for i in range(n)] + [(None, -1), (None, -2), (0, -3), (0, -4)]
    return spark.createDataFrame(rows, "id long, v int")


@pytest.mark.parametrize("n_val,n_dev", [(0, 0), (1, 1), (20, 20), (150, 151), (400, 10)])
def test_split_keeps_rows_and_sizes(spark, n_val, n_dev):
    df = odd_ids(spark)
    got = sampling.split_corpus(df, "id", n_val, n_dev).collect()
    assert sorted(r["v"] for r in got) == sorted(r["v"] for r in df.collect())
    count = collections.Counter(r["split"] for r in got)
    assert (count["val"], count["dev"]) == (min(n_val, 304), min(n_dev, max(0, 304 - n_val)))


@pytest.mark.parametrize("n", [0, 1, 7, 100, 303, 304, 1000])
def test_head_and_tail_of_any_length(spark, n, monkeypatch):
    df = odd_ids(spark)
    for seed in (42, None):
        first, last = (sampling.head(df, n, "id", seed, last=x).collect() for x in (False, True))
        assert len(first) == len(last) == min(n, 304)
        with monkeypatch.context() as m:  # the way of long prefixes gives the same rows
            m.setattr(sampling, "TOP_K", -1)
            for short, flag in ((first, False), (last, True)):
                long_ = sampling.head(df, n, "id", seed, last=flag).collect()
                assert sorted(str(r["id"]) for r in long_) == sorted(str(r["id"]) for r in short)
        if n == 7 and seed is None:
            assert {r["v"] for r in first} > {-1, -2}  # NULL ids come first


def test_positions_are_dense(spark):
    df = odd_ids(spark)
    for out in (sampling.shuffle_positions(df, "id"), ordering.index_by_int(df, "id", "pos")):
        assert sorted(r["pos"] for r in out.collect()) == list(range(304))
    hashed = spark.range(3000).select(F.xxhash64("id").alias("id"))
    pos = {r["id"]: r["idx"] for r in ordering.index_by_int(hashed, "id").collect()}
    assert [pos[x] for x in sorted(pos)] == list(range(3000))
    assert ordering.with_range_bucket(hashed, "id").select("_bucket").distinct().count() <= ordering.BUCKETS


def test_null_corpus_keys_are_a_corpus(spark):
    docs = spark.createDataFrame([(1, "en", "a\nb"), (2, None, "c"), (3, None, "d\ne"), (4, "en", "f")], "doc_id long, lang string, text string")
    got = sorted((str(r["lang"]), r["line_no"], r["line"]) for r in lines.number_lines(docs, partition_cols=["lang"]).collect())
    assert got == [("None", 0, "c"), ("None", 1, "d"), ("None", 2, "e"), ("en", 0, "a"), ("en", 1, "b"), ("en", 2, "f")]


def test_resplit_and_subsample(spark):
    df = odd_ids(spark)
    got = sampling.resplit(df.where("v % 3 = 0"), df.where("v % 3 <> 0"), "id").collect()
    assert collections.Counter(r["split"] for r in got)["train"] == df.where("v % 3 = 0").count() and len(got) == 304
    lines_ = df.withColumn("split", F.when(F.col("v") % 5 == 0, "dev").otherwise("train")).withColumn("g", F.when(F.col("v") % 2 == 0, 1))
    ref = lines_.limit(40).withColumn("split", F.lit("train"))
    kept = sampling.subsample_to(lines_, ref, "id", group_cols=["g"])
    assert kept.where("split = 'train'").groupBy("g").count().where("count <> 40").count() == 0
    assert kept.where("split = 'dev'").count() == lines_.where("split = 'dev'").count()


def test_several_scalars_in_a_line(spark):
    text = ["[2020] Ep. 1 : Up. 1000 : Sen. 64,000 : Cost 5.28 : Time 3.1s : L.r. 3.0e-04", "[valid] Ep. 1 : Up. 2000 : cross-entropy : 3.2 : new best",
            "n_lines: 7, 3.5 % of oov tokens : acc : 0.9 : f1 : 0.8 :"]
    df = spark.createDataFrame([(None, i, t) for i, t in enumerate(text)], "run int, line_no long, line string")
    got = sorted((r["line_no"], r["step"], r["key"], r["value"]) for r in logs.log_scalars(df).collect())
    assert got == [(0, 1000, "Cost", 5.28), (0, 1000, "lr", 3e-4), (1, 2000, "cross-entropy", 3.2), (2, 2000, "acc", 0.9),
                   (2, 2000, "f1", 0.8), (2, 2000, "nlines", 7.0), (2, 2000, "oov", 3.5)]


def test_partial_decoder_log_shows(spark):
    log = spark.createDataFrame([("H-1\t-0.1\t\u2581a \u2581b",), ("H-9\t-0.1\t\u2581x",)], "line string")
    refs = spark.createDataFrame([("1", "A b"), ("2", "c d e")], "id string, ref string")
    r = composites.score_dev(log, refs, "en").first()
    assert (r["ref_len"], r["sys_len"], r["unmatched_hyps"], r["unmatched_refs"]) == (5, 2, 1, 1)


def test_duplicate_piece_gives_one_id(spark):
    vocab = spark.createDataFrame([("x", 2), ("x", 3)], "piece string, id int")
    got = subword.numericalise(spark.createDataFrame([(1, "x")], "k int, pieces string"), vocab, ["k"]).first()
    assert got["ids"] == [3, 0]
