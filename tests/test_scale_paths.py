"""The ways that large or skewed inputs take give the rows of the small ones, and spread their work."""

import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from corpusforge.operators import lid, lookup, ordering, sentences, stats, truecase
from corpusforge.plans import inputs as I
from corpusforge.sources import lines


def test_a_far_off_id_does_not_fill_one_bucket(spark):
    ids = spark.range(100_000).union(spark.createDataFrame([(1 << 62,), (None,), (-5,)], "id long"))
    sizes = [r["count"] for r in ordering.with_range_bucket(ids, "id").groupBy("_bucket").count().collect()]
    assert len(sizes) > 2000 and max(sizes) < 1000
    pos = {r["id"]: r["idx"] for r in ordering.index_by_int(ids, "id").collect()}
    assert pos[None] == 0 and pos[-5] == 1 and pos[0] == 2 and pos[99_999] == 100_001 and pos[1 << 62] == 100_002


def test_positions_deal_rows_once(spark):
    """The text of a document is shuffled once while its lines are numbered: window and join ask for the same dealing."""
    docs = spark.createDataFrame([(i, "en", "a\nb " * 5) for i in range(50)], "doc_id long, lang string, text string")
    plan = lines.number_lines(docs, partition_cols=["lang"])._jdf.queryExecution().executedPlan().toString()
    above_window = plan[plan.index("SortMergeJoin"):plan.index("Window [coalesce" if "Window [coalesce" in plan else "Window")] if "SortMergeJoin" in plan else ""
    assert "Exchange" not in above_window, plan
    assert "isnull(_bucket" not in plan, plan


def test_line_numbers_over_files_of_falling_size(spark, tmp_path):
    for name, n in (("a.txt", 5000), ("b.txt", 500), ("c.txt", 3)):
        (tmp_path / name).write_text("".join(f"{name}:{i}\n" for i in range(n)))
    with_small_splits = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = {r["line_no"]: r["line"] for r in lines.read_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", with_small_splits)
    want = [f"{name}:{i}" for name, n in (("a.txt", 5000), ("b.txt", 500), ("c.txt", 3)) for i in range(n)]
    assert [got[i] for i in range(len(want))] == want and len(got) == len(want)


def tokenised(spark):
    rng = random.Random(3)
    words = ["House", "house", "the", "The", "Paris", "ran", "x1", "Fell", "fell"]
    rows = [(i, "en" if i % 3 else None, " ".join(rng.choice(words) for _ in range(rng.randrange(12))) + " .") for i in range(200)]
    return spark.createDataFrame([*rows, (900, "en", ""), (901, "en", None), (902, "zz", "The unknown .")], "k long, lang string, text string")


@pytest.mark.parametrize("heavy", [0, 2, 4])
def test_truecase_by_join_equals_truecase_in_the_line(spark, monkeypatch, heavy):
    """Half of all tokens are one word: it is looked up in the line, the others by a join."""
    df = tokenised(spark)
    hot = df.withColumn("text", F.when(F.col("k") < 200, F.concat("text", F.lit(" the" * 12))).otherwise(F.col("text")))
    model = truecase.truecase_fit(hot, "text", ["lang"])
    want = {r["k"]: r["t"] for r in truecase.truecase_apply(hot, model, ["k"], "text", "t", ["lang"]).collect()}
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(lookup, "HEAVY", max(heavy, 1))
    asked = []
    split = lookup.split_model
    monkeypatch.setattr(truecase, "split_model", lambda *a: asked.append(split(*a)) or asked[-1])
    got = {r["k"]: r["t"] for r in truecase.truecase_apply(hot, model, ["k"], "text", "t", ["lang"]).collect()}
    assert got == want and len(want) == 203
    assert not asked[0].whole and any(k.endswith("the") for k in asked[0].known)  # the hot word never leaves its line
    assert len(asked[0].known) <= 3 + max(heavy, 1)


def test_language_sums_by_join_equal_those_in_the_line(spark, monkeypatch):
    df = I.doc_lines(spark, SF001).where("doc_id < 40").select("doc_id", "line_in_doc", "lang", "line")
    model = lid.lid_fit(df)
    ids = ["doc_id", "line_in_doc"]
    want = {tuple(r[:2]): (r["pred"], r["pred_score"]) for r in lid.lid_predict(df, model, ids).collect()}
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 50)
    monkeypatch.setattr(lookup, "HEAVY", 20)
    got = {tuple(r[:2]): (r["pred"], r["pred_score"]) for r in lid.lid_predict(df, model, ids).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in want)


def test_many_languages_do_not_widen_the_plan(spark):
    def plan(n):
        df = spark.createDataFrame([(i, f"l{i % n}", f"text number {i}") for i in range(n)], "k int, lang string, line string")
        out = lid.lid_predict(df, lid.lid_fit(df), ["k"])
        assert out.count() == n and {len(r) for r in out.columns} and out.where("pred IS NULL").count() == 0
        return out
    few, many = plan(3), plan(300)
    assert few.columns == many.columns
    assert len(many._jdf.queryExecution().analyzed().treeString().split("\n")) == len(few._jdf.queryExecution().analyzed().treeString().split("\n"))


def test_grids_of_200_corpora(spark):
    rng = random.Random(4)
    counts = {f"c{i}": {f"g{rng.randrange(60)}": rng.randrange(1, 9) for _ in range(rng.randrange(25))} for i in range(200)}
    rows = [(c, g, n) for c, v in counts.items() for g, n in v.items()]
    df = spark.createDataFrame([*rows, ("other", "g1", 3)], "corpus string, gram string, n long")
    train, dev = [f"c{i}" for i in range(120)], [f"c{i}" for i in range(100, 200)]
    kl = {(r["train"], r["dev"]): r for r in stats.kl_grid(df, train, dev, weight="n").collect()}
    oov = {(r["train"], r["dev"]): r for r in stats.oov_grid(df, train, dev, token_col="gram", weight="n").collect()}
    assert len(kl) == len(oov) == 120 * 100
    for t, d in [(rng.choice(train), rng.choice(dev)) for _ in range(300)]:
        a, b = counts[t], counts[d]
        union = a.keys() | b.keys()
        assert kl[t, d]["n_grams"] == len(union)
        if union:
            sa, sb = (sum(x.values()) + len(union) for x in (a, b))
            want = sum((b.get(g, 0) + 1) / sb * math.log(((b.get(g, 0) + 1) / sb) / ((a.get(g, 0) + 1) / sa)) for g in union)
            assert kl[t, d]["kl_dev_train"] == pytest.approx(want, abs=2e-6)
        missing = [g for g in b if g not in a]
        r = oov[t, d]
        assert (r["n_oov"], r["n_tokens"], r["n_unique_oov"], r["n_unique"]) == (sum(b[g] for g in missing), sum(b.values()), len(missing), len(b))
        assert (r["oov"] is None) == (not b)


def test_learnt_abbreviations(spark):
    text = [f"We met Mgr. {name} and many other people at the old house." for name in ("Tolva", "Ander", "Bree", "Cort", "Dann", "Elm")]
    text += [f"It took us ca. {n} days of slow and hard work to reach the house." for n in ("Nine", "Ten", "Four", "Six")]
    text += ["The house lies by the lake and the house is old and big and dark", "A house is a house is a house"]
    df = spark.createDataFrame([(i, "xx", t) for i, t in enumerate(text)], "k int, lang string, line string")
    model = sentences.abbreviation_fit(df)
    found = {r["word"]: r["is_abbreviation"] for r in model.collect()}
    assert found == {"mgr": True, "ca": True, "house": False}
    new = spark.createDataFrame([(0, "xx", "Mgr. Bo sat. He ate ca. Ten  cakes! Was it the house. Yes."), (1, "yy", "Mgr. Bo sat."), (2, None, "One. Two"),
                                 (3, "xx", ""), (4, "xx", None)], "k int, lang string, line string")
    got = {}
    for r in sorted(sentences.split_sentences(new, model).collect(), key=lambda r: (r["k"], r["sent_no"])):
        got.setdefault(r["k"], []).append(r["sentence"])
    assert got == {0: ["Mgr. Bo sat.", "He ate ca. Ten  cakes!", "Was it the house.", "Yes."], 1: ["Mgr.", "Bo sat."], 2: ["One.", "Two"]}


def test_words_that_keep_their_full_stop(spark):
    from corpusforge.functions.rules import normalise_tokenise
    rows = [("en", "Mr. Smith saw No. 5.", "Mr. Smith saw No. 5 ."), ("de", "z. B. Haus Nr. 7 am Ende.", "z. B. Haus Nr. 7 am Ende ."),
            ("en", "No. He left the house. It fell... and", "No . He left the house . It fell... and"), ("en", "the U.S. Army etc.", "the U.S. Army etc ."),
            ("fr", "M. Dupont, p. ex. ici.", "M. Dupont , p. ex. ici ."), ("xx", "Mr. Smith went. then", "Mr . Smith went. then"), ("en", "", ""), (None, "a. B", "a . B")]
    df = spark.createDataFrame([(i, lang, text) for i, (lang, text, _) in enumerate(rows)], "k int, lang string, line string")
    got = {r["k"]: r["t"] for r in df.select("k", normalise_tokenise("line", "lang").alias("t")).collect()}
    assert [got[i] for i in range(len(rows))] == [want for _, _, want in rows]


def test_punctuation_by_language(spark):
    from corpusforge.functions.rules import normalise
    rows = [("fr", "Il dit : « Bonjour ! » et «\u00a0Non\u202f».", 'Il dit : "Bonjour !" et "Non".'), ("de", "\u201eHallo,\u201c sagte er : ja", '"Hallo", sagte er: ja'),
            ("en", "\u201cHello\u201d, he said. \u201cNo\u201d.", '"Hello," he said. "No."'), ("es", "\u00abHola,\u00bb dijo", '"Hola", dijo'), ("xx", '"a", "b".', '"a", "b".')]
    df = spark.createDataFrame([(i, lang, text) for i, (lang, text, _) in enumerate(rows)], "k int, lang string, line string")
    got = {r["k"]: r["t"] for r in df.select("k", normalise("line", "lang").alias("t")).collect()}
    assert [got[i] for i in range(len(rows))] == [want for _, _, want in rows]
