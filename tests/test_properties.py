"""Properties of the operators on the shared tables (small scale)."""

import random

import pytest

from pyspark.sql import functions as F

from conftest import SF001
from corpusforge.operators import bpe, sampling, stats, subword
from corpusforge.plans import inputs as I


def test_split_sizes_disjoint_and_complete(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "k")
    out = sampling.split_corpus(df, "k", 500, 700, seed=3)
    sizes = {r.split: r.c for r in out.groupBy("split").agg(F.count("*").alias("c")).collect()}
    assert sizes == {"val": 500, "dev": 700, "train": 1800}
    assert out.select("k").distinct().count() == 3000


def test_large_split_uses_positions_and_agrees(spark):
    df = spark.range(0, 30000).withColumnRenamed("id", "k")
    big = sampling.split_corpus(df, "k", 6000, 6000, seed=5)   # above the top-k threshold
    pos = sampling.shuffle_positions(df, "k", 5)
    want = {r.k: ("val" if r.pos < 6000 else "dev" if r.pos < 12000 else "train") for r in pos.collect()}
    got = {r.k: r.split for r in big.collect()}
    assert got == want


def test_shuffle_is_permutation_and_partition_independent(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "k")
    a = {r.k: r.pos for r in sampling.shuffle_positions(df, "k", 11).collect()}
    b = {r.k: r.pos for r in sampling.shuffle_positions(df.repartition(3), "k", 11, hex_digits=2).collect()}
    assert sorted(a.values()) == list(range(5000))
    assert a == b


def test_head_tail_agree_with_positions(spark):
    df = spark.range(0, 20000).withColumnRenamed("id", "k")
    pos = {r.k: r.pos for r in sampling.shuffle_positions(df, "k", 2).collect()}
    small = {r.k for r in sampling.head(df, 50, "k", 2).collect()}
    large = {r.k for r in sampling.head(df, 12000, "k", 2).collect()}
    tail = {r.k for r in sampling.head(df, 12000, "k", 2, last=True).collect()}
    assert small == {k for k, p in pos.items() if p < 50}
    assert large == {k for k, p in pos.items() if p < 12000}
    assert tail == {k for k, p in pos.items() if p >= 8000}


def test_kl_and_oov_of_identical_corpora(spark):
    lines = I.doc_lines(spark, SF001).where(F.col("lang") == "en")
    grams = lines.select(F.lit("x").alias("corpus"), F.explode(F.split("line", "")).alias("gram"))
    both = grams.unionByName(grams.withColumn("corpus", F.lit("y")))
    r = stats.kl_grid(both, ["x"], ["y"]).collect()[0]
    assert r.kl_dev_train == 0.0
    toks = both.withColumnRenamed("gram", "token")
    o = stats.oov_grid(toks, ["x"], ["y"]).collect()[0]
    assert o.n_oov == 0 and o.oov == 0.0
    kl = stats.kl_grid(both, ["x", "y"], ["y"]).collect()
    assert all(r.kl_dev_train >= 0 for r in kl)


def _sequential_bpe(freqs: dict, n_merges: int):
    words = {w: list("▁" + w) for w in freqs}
    merges = []
    for _ in range(n_merges):
        counts = {}
        for w, syms in words.items():
            for a, b in zip(syms, syms[1:]):
                counts[(a, b)] = counts.get((a, b), 0) + freqs[w]
        cands = [(-n, p) for p, n in counts.items() if n >= 2]
        if not cands:
            break
        best = min(cands)[1]
        merges.append(best)
        for w, syms in words.items():
            out, i = [], 0
            while i < len(syms):
                if i < len(syms) - 1 and (syms[i], syms[i + 1]) == best:
                    out.append(syms[i] + syms[i + 1])
                    i += 2
                else:
                    out.append(syms[i])
                    i += 1
            words[w] = out
    return merges, {w: " ".join(s) for w, s in words.items()}


def _small_words(spark):
    rnd = random.Random(7)
    alphabet = "abcde"
    text = [" ".join("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 6))) for _ in range(8))
            for _ in range(60)]
    return subword.word_table(spark.createDataFrame([(t,) for t in text], "line string"), "line")


@pytest.mark.parametrize("proposal_words", [1, 5, 1000])
def test_bpe_is_the_sequential_one(spark, monkeypatch, proposal_words):
    """Whatever the proposer sees, the merges are those of counting anew after every merge."""
    monkeypatch.setattr(bpe, "PROPOSAL_WORDS", proposal_words)
    monkeypatch.setattr(bpe, "STANDINGS", 20)
    words = _small_words(spark)
    freqs = {r.word: r.freq for r in words.collect()}
    n_chars = len({c for w in freqs for c in "▁" + w})
    vocab, final = bpe.bpe_learn(words, 3 + n_chars + 25)
    got = [(r.left, r.right) for r in vocab.where("kind = 'merge'").orderBy("rank").collect()]
    want, want_words = _sequential_bpe(freqs, 25)
    assert got == want
    assert {r.word: r.syms for r in final.collect()} == want_words
    enc = bpe.bpe_encode(words.select("word"), vocab, "word")
    assert {r.word: r.pieces for r in enc.collect()} == want_words


def test_bpe_of_16000_merges(spark, monkeypatch):
    """All documents of the small table: merges proposed and proved are those that one greedy run over all words picks; the
    first 60 are those of recounting everything, also where 2,000 words propose."""
    words = subword.word_table(I.doc_lines(spark, SF001), "line").checkpoint()
    rows = [(r.syms.split(" "), r.freq) for r in words.collect()]
    want = bpe.Proposer(list(rows), {}).propose(16_000, 2)
    assert want[:60] == _sequential_bpe({"".join(s)[1:]: f for s, f in rows}, 60)[0]
    got = bpe.merges_of(words, 16_000)
    assert [p for p, _ in got] == want and got[-1][1] >= 2 and len(got) > 5_000
    monkeypatch.setattr(bpe, "PROPOSAL_WORDS", 2_000)
    assert bpe.merges_of(words, 30) == got[:30]


def test_bpe_refuses_a_vocabulary_without_merges(spark):
    with pytest.raises(ValueError):
        bpe.bpe_learn(_small_words(spark), 9)
    assert bpe.bpe_learn(_small_words(spark).where("false"), 9)[0].count() == 3


def test_bpe_pair_merged_twice():
    """A symbol that is spelled in two ways: the later merge brings an earlier pair back, which only a new step merges."""
    steps = bpe.steps_of([("b", "c"), ("a", "bc"), ("abc", "d"), ("a", "b"), ("ab", "c"), ("abc", "d")])
    assert bpe.segmented(list("abcd"), steps) == ["abcd"]
    assert bpe.segmented(["ab", "c", "d"], steps) == ["abcd"]
    assert bpe.segmented(["ab", "c", "d"], bpe.steps_of([("abc", "d"), ("ab", "c")])) == ["abc", "d"]
