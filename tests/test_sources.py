"""Sources and sinks: files, registry, vocabulary files, pair export."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from corpusforge.sources import align, lines, registry, sinks


def _tmp():
    return tempfile.mkdtemp(prefix="src-")


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_registry_reads_and_tags(spark):
    d = _tmp()
    _write(os.path.join(d, "a.txt"), "x\ny\n")
    _write(os.path.join(d, "b.txt"), "z\n")
    reg = registry.corpora(spark, [("A", "train", os.path.join(d, "a.txt"), "fr", "en"),
                                   ("B", "dev", os.path.join(d, "b.txt"), "fr", "en")])
    got = sorted(tuple(r) for r in registry.read_registered(spark, reg, lines.read_lines)
                 .select("corpus", "role", "line_no", "line").collect())
    assert got == [("A", "train", 0, "x"), ("A", "train", 1, "y"), ("B", "dev", 0, "z")]
    only_dev = registry.read_registered(spark, reg, lines.read_lines, role="dev")
    assert only_dev.count() == 1


def test_join_registered_single_scan(spark):
    lines = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("c", "w")], "src string, line string")
    reg = registry.corpora(spark, [("A", "train", "a", "fr", "en"), ("B", "dev", "b", "fr", "en")])
    got = sorted(tuple(r) for r in registry.join_registered(lines, reg, "src").select("corpus", "role", "line")
                 .collect())
    assert got == [("A", "train", "x"), ("A", "train", "y"), ("B", "dev", "z")]
    assert registry.join_registered(lines, reg, "src", role="dev").count() == 1


def test_joint_vocabulary_rule():
    registry.check_joint("bpe", "bpe", 16000, 16000)
    registry.check_joint("char", "char", None, 5)
    with pytest.raises(ValueError):
        registry.check_joint("bpe", "char", 16000, None)
    with pytest.raises(ValueError):
        registry.check_joint("bpe", "bpe", 16000, 32000)


def test_read_tsv_and_vocab_file(spark):
    d = _tmp()
    _write(os.path.join(d, "p.tsv"), "1\tbonjour\thello\n2\tsalut\n")
    t = align.read_tsv(spark, os.path.join(d, "p.tsv"), ["id", "src", "tgt"], missing="empty")
    assert [tuple(r) for r in t.orderBy("line_no").collect()] == [(0, "1", "bonjour", "hello"), (1, "2", "salut", "")]
    _write(os.path.join(d, "m.vocab"), "<unk>\t0\n<s>\t0\n</s>\t0\n▁a\t-1.5\nb\t-2\n")
    v = align.read_vocab(lines.read_lines(spark, os.path.join(d, "m.vocab")))
    assert [tuple(r) for r in v.orderBy("id").collect()] == [(0, "▁a", -1.5), (1, "b", -2.0)]
    js = json.loads(sinks.vocab_to_json(v.withColumn("id", F.col("id") + 2)).collect()[0][0])
    assert js == {"</s>": 0, "<unk>": 1, "▁a": 2, "b": 3}


def test_hypotheses_from_decoder_log(spark):
    log = spark.createDataFrame([(0, "S-0\tsource"), (1, "H-0\t-0.4\t▁he llo"), (2, "P-0\t-0.1"),
                                 (3, "H-1\t-0.2\t▁x")], "line_no long, line string")
    got = [tuple(r) for r in align.read_hypotheses(log).orderBy("line_no").collect()]
    assert got == [(1, "▁he llo"), (3, "▁x")]


def test_write_pairs_round_trip_and_side_export(spark):
    d = _tmp()
    pairs = spark.createDataFrame([(i, f"s{i}", f"t{i}", "train" if i % 3 else "dev") for i in range(40)],
                                  "line_no long, src string, tgt string, split string")
    sinks.write_pairs(pairs, os.path.join(d, "pq"), ["line_no"])
    back = spark.read.parquet(os.path.join(d, "pq"))
    assert sorted(tuple(r) for r in back.select("line_no", "src", "tgt", "split").collect()) == \
        sorted(tuple(r) for r in pairs.collect())
    sinks.export_side(pairs.repartition(5), os.path.join(d, "src"), "line_no", "src", 16)
    sinks.export_side(pairs, os.path.join(d, "tgt"), "line_no", "tgt", 16)

    def read(side, i):
        at = os.path.join(d, side, f"file={i}")
        (name,) = [f for f in os.listdir(at) if f.startswith("part-")]
        return open(os.path.join(at, name)).read().splitlines()

    for i, want in enumerate((range(16), range(16, 32), range(32, 40))):
        assert [x[1:] for x in read("src", i)] == [x[1:] for x in read("tgt", i)] == [str(k) for k in want]


def test_size_table(spark):
    d = _tmp()
    stats = spark.createDataFrame([("b", 2, 1.5, 3.0, 50.0), ("a", 1, 2.0, 4.0, 100.0)],
                                  "corpus string, n_lines int, mean_line_tokens double, mean_token_bytes double, pct_unique double")
    sinks.write_stats(stats, os.path.join(d, "t"))
    (name,) = [f for f in os.listdir(os.path.join(d, "t")) if f.startswith("part-")]
    lines = open(os.path.join(d, "t", name)).read().splitlines()
    assert lines == [*sinks.TABLE_HEAD, "a & 1 & 2.0 & 4.0 & 100.0 \\\\", "b & 2 & 1.5 & 3.0 & 50.0 \\\\", *sinks.TABLE_FOOT]


def test_grid_csv_and_tex_export(spark):
    d = _tmp()
    grid = spark.createDataFrame([("EuParl", "News", 1.234), ("EuParl", "MTNT", 2.0), ("News", "News", 0.5)],
                                 "train string, dev string, kl double")
    f = sinks.format_grid(grid, "kl", "train", "dev", ["News", "MTNT"], 2, row_order=["EuParl", "News"])
    rows = {r.train: (r.rank, r.News, r.MTNT, r.tex) for r in f.collect()}
    assert rows["EuParl"] == (0, "1.23", "2.00", "EuParl & 1.23 & 2.00 \\\\")
    assert rows["News"] == (1, "0.50", None, "News & 0.50 &  \\\\")
    sinks.write_grid(f, os.path.join(d, "csv"), "csv")
    sinks.write_grid(f, os.path.join(d, "tex"), "tex")
    csv = [ln for fn in sorted(os.listdir(os.path.join(d, "csv"))) if fn.endswith(".csv")
           for ln in open(os.path.join(d, "csv", fn)).read().splitlines()]
    assert csv[0] == "train,News,MTNT" and csv[1].startswith("EuParl,1.23")


def test_relabel_and_direction(spark):
    df = spark.createDataFrame([("test", "en", "fr", "a", "b"), ("valid", "fr", "en", "c", "d")],
                               "split string, src_lang string, tgt_lang string, src string, tgt string")
    r = align.relabel_split(df, {"test": "dev", "valid": "val"})
    assert sorted(x.split for x in r.collect()) == ["dev", "val"]
    c = {tuple(x) for x in align.canonical(df, english_target=True).select("src_lang", "tgt_lang", "src", "tgt")
         .collect()}
    assert c == {("fr", "en", "b", "a"), ("fr", "en", "c", "d")}
    rv = align.reverse(df).select("src_lang", "tgt_lang", "src", "tgt").collect()
    assert tuple(rv[0]) == ("fr", "en", "b", "a")


def test_read_lines_numbering_across_many_splits(spark):
    d = _tmp()
    p = os.path.join(d, "big.txt")
    want = [f"line {i} " + "x" * (i % 37) for i in range(3000)]
    _write(p, "\n".join(want) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = lines.read_lines(spark, p)
        assert df.rdd.getNumPartitions() > 1
        got = [(r.line_no, r.line) for r in df.orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(enumerate(want))
