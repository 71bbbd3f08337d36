"""Work that must grow no faster than the rows: what is looked at one by one, dealt by a few keys or held at once."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import SF001

from corpusforge.functions.rules import NEEDS, normalise_tokenise
from corpusforge.operators import bpe, rows
from corpusforge.operators.sentences import split_sentences
from corpusforge.operators.lookup import Split
from corpusforge.operators.truecase import cased, cased_lines, detruecase, flagged, not_starting
from corpusforge.plans import catalog
from corpusforge.plans.composites import preprocess_monolingual


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sentence_starts_by_one_expression(spark):
    rnd = random.Random(5)
    lines = [" ".join(rnd.choice([".", "?", '"', "(", "¿", "ab", "ßa", "a.", "..", ""]) for _ in range(rnd.randint(0, 9))) for _ in range(300)]
    for r in spark.createDataFrame([(x,) for x in lines], "s string").select("s", not_starting("s").alias("rest"), detruecase("s").alias("up")).collect():
        toks = [t for t in r.s.split(" ") if t]
        assert r.rest == [t for t, start in zip(toks, flagged(toks)) if not start]
        assert r.up == " ".join(t[0].upper() + t[1:] if start and t[0] != "ß" else t for t, start in zip(toks, flagged(toks)))


def test_rules_are_skipped_where_they_change_nothing(spark):
    df = spark.createDataFrame([("en", 'a-b-c, "d." e\t f'), ("fr", "a ! b"), (None, "x  y, z")], "lang string, s string")
    got = [r[0] for r in df.select(normalise_tokenise("s", "lang")).collect()]
    assert got == ['a @-@ b @-@ c , " d . " e f', "a ! b", "x y , z"] and NEEDS


def test_no_line_is_dealt_by_its_language(spark):
    lines = spark.createDataFrame([(i, ["en", "de", None][i % 3], "One xy. Two") for i in range(99)], "id int, lang string, line string")
    model = spark.createDataFrame([("en", "xy", True)], "lang string, word string, is_abbreviation boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = split_sentences(lines, model)
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 33 + 2 * 66
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rules_run_once_before_the_filter(spark, monkeypatch):
    seen = []
    from corpusforge.plans import composites
    monkeypatch.setattr(composites, "_kept", lambda df, *_: seen.append(plan_of(df)) or df)
    lines = spark.createDataFrame([(1, "en", "train", "A b.")], "id int, lang string, split string, line string")
    assert [r.text for r in preprocess_monolingual(lines, ["id"]).collect()] == ["A b ."]
    assert seen[0].startswith("Filter") and "translate(" not in seen[0].split("\n")[0]


def test_values_go_to_python_in_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 100_000] * 100)], ["v"])
    parts = list(rows.slices(batch))
    assert sum(p.num_rows for p in parts) == 100 and max(p.num_rows for p in parts) <= 11


def test_proposals_go_on_after_merges(spark):
    rnd = random.Random(2)
    words = [([rnd.choice("ab") for _ in range(rnd.randint(1, 9))], rnd.randint(1, 9)) for _ in range(80)]
    whole = bpe.Proposer(words, {}).propose(40, 2)
    assert len(whole) == 40 and bpe.Proposer(words, {}, whole[:15]).propose(25, 2) == whole[15:]


def test_words_replayed_by_arrays():
    """All words at once change the counts of pairs as word after word does, also where merges come in another order."""
    rnd = random.Random(3)
    for trial in range(60):
        words = [([rnd.choice("ab" if trial % 2 else "abc") for _ in range(rnd.randint(1, 9))], rnd.randint(1, 9)) for _ in range(30)]
        merges = bpe.Proposer(words, {}).propose(rnd.randint(0, 20), 2)
        rnd.shuffle(merges)
        base, steps, want, got = rnd.randint(0, len(merges)), bpe.steps_of(merges), Counter(), Counter()
        for syms, freq in words:
            want.update({(pair, 0): freq * n for pair, n in Counter(zip(syms, syms[1:])).items()})
            for step, before, after in bpe.replay(syms, steps):
                for sign, some in ((-freq, before), (freq, after)):
                    for pair in zip(some, some[1:]):
                        want[pair, max(step - base + 1, 0)] += sign
        book = bpe.Numbered.of(["a", "b", "c"], merges)
        sym, lengths = (np.array(x) for x in ([book.ids[s] for w, _ in words for s in w], [len(w) for w, _ in words]))
        for keys, word, sign in book.replayed(sym, lengths, base):
            for key, w in zip(keys.tolist(), word.tolist()):
                got[book.pair(key >> book.step_bits), key & (1 << book.step_bits) - 1] += sign * words[w][1]
        assert {k: n for k, n in got.items() if n} == {k: n for k, n in want.items() if n}


def test_rare_words_stand_for_others(spark, monkeypatch):
    words = spark.createDataFrame([(f"w{i}", 9 if i < 20 else 1, "a b") for i in range(2_000)], "word string, freq long, syms string")
    assert {(r.freq, r.weight) for r in bpe.weighed(words).collect()} == {(9, 9), (1, 1)}
    monkeypatch.setattr(bpe, "PROPOSAL_WORDS", 400)
    seen = [(r.freq, r.weight) for r in bpe.weighed(words).where("weight > 0").collect()]
    assert set(seen) == {(9, 9), (1, 10)} and 120 < len(seen) < 300


def test_lines_are_tokenised_once_for_bpe(spark, monkeypatch):
    monkeypatch.setattr(catalog, "BPE_VOCAB", 400)
    for name in ("segment_corpus", "subword_encode_bpe"):
        assert "regexp_replace" not in plan_of(catalog.QUERIES[name](spark, SF001))


def test_lines_cased_by_arrays():
    """Tokens cased all at once are those cased one after another; a token without cases never leaves its line."""
    rnd = random.Random(6)
    model = {"en\u0001the": {"_best": "the", "_forms": ["the", "The"]}, "en\u0001paris": {"_best": "Paris", "_forms": ["Paris"]}, "en\u0001x": None}
    words = ["the", "The", "THE", "paris", "Paris", "X", "x", ".", "?", '"', "(", "12", "", "Rare", "rare"]
    lines = [None, "", " ", *(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))) for _ in range(300))]
    rows = [{"line": x, "low": x and x.lower(), "prefix": rnd.choice(["en\u0001", "de\u0001"])} for x in lines]
    rest = pa.list_(pa.struct([("i", pa.int32()), ("key", pa.string()), ("t", pa.string()), ("s", pa.bool_())]))
    kind = pa.struct([("text", pa.string()), ("rest", rest)])
    given = pa.array(rows, pa.struct([(c, pa.string()) for c in ("line", "low", "prefix")]))
    for whole in (False, True):
        for start in (0, 7):  # also of a slice
            for row, got in zip(rows[start:], cased_lines(given[start:], Split(model, whole), kind).to_pylist(), strict=True):
                toks = [t for t in (row["line"] or "").split(" ") if t]
                want, left = [], []
                for i, (t, s) in enumerate(zip(toks, flagged(toks))):
                    key = row["prefix"] + t.lower()
                    v = model.get(key)
                    want.append(cased(t, s, v["_best"], v["_forms"]) if v else t)
                    if not whole and key not in model and t.upper() != t.lower():
                        left.append({"i": i, "key": key, "t": t, "s": s})
                assert (got["text"], got["rest"]) == (" ".join(want), left)
