"""Hand-made golden inputs for the semantics rules."""

import math
import os
import tempfile

from pyspark.sql import functions as F

from corpusforge.functions.text import char_windows, chars, decode_pieces, char_pieces, tokens, token_ngrams
from corpusforge.operators import filters, logs, metrics, stats, subword, truecase
from corpusforge.sources import align, lines, sinks


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_char_windows_short_lines(spark):
    df = spark.createDataFrame([("",), ("a",), ("ab",), ("abc",)], "line string")
    got = [r[0] for r in df.select(char_windows("line", 3)).collect()]
    assert got == [["\n"], ["a\n"], ["ab\n"], ["abc", "bc\n"]]


def test_astral_character_stays_whole(spark):
    df = spark.createDataFrame([("a\U0001F600b",)], "s string")
    assert one(df.select(chars("s")))[0] == ["a", "\U0001F600", "b"]
    assert one(df.select(char_windows("s", 2, newline=False)))[0] == ["a\U0001F600", "\U0001F600b"]


def test_unicode_whitespace_tokens(spark):
    df = spark.createDataFrame([(" a b　c\td  e ",)], "s string")
    assert one(df.select(tokens("s")))[0] == ["a", "b", "c", "d", "e"]


def test_read_lines_crlf_and_last_line(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "x.txt")
    with open(p, "wb") as f:
        f.write(b"one\r\ntwo\n\nfour")
    got = [(r.line_no, r.line) for r in lines.read_lines(spark, p).orderBy("line_no").collect()]
    assert got == [(0, "one"), (1, "two"), (2, ""), (3, "four")]


def test_split_lines_final_newline(spark):
    df = spark.createDataFrame([(1, "a\nb\n"), (2, "c")], "doc_id long, text string")
    got = sorted((r.doc_id, r.line_in_doc, r.line) for r in lines.explode_lines(df).collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]


def test_number_lines_dense_per_corpus(spark):
    df = spark.createDataFrame([(5, "x", "a\nb"), (9, "x", "c"), (7, "y", "d\ne\nf")],
                               "doc_id long, corpus string, text string")
    got = sorted((r.corpus, r.line_no, r.line) for r in lines.number_lines(df, partition_cols=["corpus"], width=2).collect())
    assert got == [("x", 0, "a"), ("x", 1, "b"), ("x", 2, "c"), ("y", 0, "d"), ("y", 1, "e"), ("y", 2, "f")]


def test_tsv_row_without_tab(spark):
    df = spark.createDataFrame([("a\tb",), ("only",), ("x\t",)], "line string")
    got = df.select(align.tsv_field("line", 1).alias("f1"), align.tsv_field("line", 2).alias("f2"),
                    align.tsv_field("line", 2, "null").alias("n2")).collect()
    assert [tuple(r) for r in got] == [("a", "b", "b"), ("only", "only", None), ("x", "", "")]


def test_paste_pads_and_zip_truncates(spark):
    a = spark.createDataFrame([(0, "a0"), (1, "a1"), (2, "a2")], "line_no long, line string")
    b = spark.createDataFrame([(0, "b0")], "line_no long, line string")
    p = sorted(tuple(r) for r in align.paste(a, b).collect())
    assert p == [(0, "a0", "b0"), (1, "a1", ""), (2, "a2", "")]
    z = align.zip_lines("line_no", (a, "line", "s"), (b, "line", "t")).collect()
    assert [tuple(r) for r in z] == [(0, "a0", "b0")]


def test_clean_ratio_and_length_bounds(spark):
    def toks(n):
        return " ".join(["w"] * n)
    rows = [(1, toks(9), toks(5)),   # ratio exactly 1.8: kept
            (2, toks(10), toks(5)),  # 2.0: dropped
            (3, toks(100), toks(100)),  # 100 tokens: kept
            (4, toks(101), toks(100)),  # 101: dropped
            (5, "", toks(1))]          # 0 tokens: dropped
    df = spark.createDataFrame(rows, "id int, src string, tgt string")
    kept = sorted(r.id for r in filters.clean_pairs(df, splits=None).collect())
    assert kept == [1, 3]


def test_mono_length_strict(spark):
    df = spark.createDataFrame([(1, " ".join(["w"] * 99)), (2, " ".join(["w"] * 100)), (3, "")], "id int, line string")
    assert sorted(r.id for r in filters.max_tokens(df, "line", 100).collect()) == [1, 3]


def test_label_suffix_rule(spark):
    df = spark.createDataFrame([("__label__ceb",), ("__label__fr",)], "l string")
    got = df.select(align.parse_label("l").alias("exact"), align.parse_label("l", True).alias("s2")).collect()
    assert [tuple(r) for r in got] == [("ceb", "eb"), ("fr", "fr")]


def test_lid_filter_train_only(spark):
    df = spark.createDataFrame([(1, "train", "__label__fr", "__label__en"), (2, "train", "__label__de", "__label__en"),
                                (3, "dev", "__label__de", "__label__de")],
                               "id int, split string, src_label string, tgt_label string")
    assert sorted(r.id for r in filters.lid_filter(df, "fr", "en").collect()) == [1, 3]


def test_vocab_json_duplicate_piece_and_reserved_ids(spark):
    v = spark.createDataFrame([(2, "a"), (3, "b"), (4, "a")], "id int, piece string")
    js = one(sinks.vocab_to_json(v))[0]
    import json
    assert json.loads(js) == {"</s>": 0, "<unk>": 1, "a": 4, "b": 3}
    assert [r[0] for r in sinks.vocab_to_dict(v).collect()] == ["a 100", "b 100", "a 100"]


def test_numericalise_unknown_token(spark):
    vocab = spark.createDataFrame([("x", 2), ("y", 3)], "piece string, id int")
    df = spark.createDataFrame([(1, "x z y"), (2, "")], "k int, pieces string")
    got = {r.k: r.ids for r in subword.numericalise(df, vocab, ["k"]).collect()}
    assert got == {1: [2, 1, 3, 0], 2: [0]}


def test_truecase_initial_known_and_unknown(spark):
    train = spark.createDataFrame([(1, "the House is big ."), (2, "a House and the house ."), (3, "we saw Paris .")],
                                  "k int, text string")
    model = truecase.truecase_fit(train, "text")
    best = {r.lc: r.form for r in model.where("is_best").collect()}
    assert best["house"] == "House" and best["paris"] == "Paris"
    test = spark.createDataFrame([(1, "The house in PARIS . Zebra runs .")], "k int, text string")
    out = one(truecase.truecase_apply(test, model, ["k"], "text", "text"))
    # initial 'The' -> best 'the'; known 'house' kept; unknown-form 'PARIS' -> best; unknown word kept
    assert out.text == "the house in Paris . Zebra runs ."


def test_detruecase_skips_sharp_s(spark):
    df = spark.createDataFrame([("ßa bc . de",)], "s string")
    assert one(df.select(truecase.detruecase("s")))[0] == "ßa bc . De"


def test_bleu_identity_and_short_hypothesis(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat"),
                                (2, "a b c d e", "a b c d e")], "k int, hyp string, ref string")
    assert one(metrics.bleu(df, ["k"])).bleu == 100.0
    short = spark.createDataFrame([(1, "the cat", "the cat sat on the mat")], "k int, hyp string, ref string")
    r = one(metrics.bleu(short, ["k"]))
    assert r.total_3 == 0 and r.bleu < 1e-3 and r.matches_1 == 2


def test_bleu_matches_direct_computation(spark):
    import collections
    pairs = [("the cat is on the mat", "there is a cat on the mat"), ("hello world !", "hello there world !")]
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)], "k int, hyp string, ref string")
    r = one(metrics.bleu(df, ["k"]))
    m = [0] * 4
    t = [0] * 4
    for h, ref in pairs:
        h, ref = h.split(), ref.split()
        for n in range(1, 5):
            hc = collections.Counter(tuple(h[i:i + n]) for i in range(len(h) - n + 1))
            rc = collections.Counter(tuple(ref[i:i + n]) for i in range(len(ref) - n + 1))
            m[n - 1] += sum(min(c, rc[g]) for g, c in hc.items())
            t[n - 1] += sum(hc.values())
    assert [r.matches_1, r.matches_2, r.matches_3, r.matches_4] == m
    assert [r.total_1, r.total_2, r.total_3, r.total_4] == t


def test_log_value_before_first_step(spark):
    df = spark.createDataFrame([(0, 0, ": loss : 2.5 :"), (0, 1, ": Up. 100 :"), (0, 2, ": loss : 1.5 :"),
                                (0, 3, "BLEU+case.mixed = 12.5"), (0, 4, "n_lines: 7"), (0, 5, "3.5 % of oov tokens"),
                                (0, 6, "L.r. 0.001"), (0, 7, ": acc 0.9 :")], "run int, line_no long, line string")
    got = [tuple(r) for r in logs.log_scalars(df, width=2).orderBy("line_no").collect()]
    assert got == [(0, 0, None, "loss", 2.5), (0, 2, 100, "loss", 1.5), (0, 3, 100, "BLEU", 12.5),
                   (0, 4, 100, "nlines", 7.0), (0, 5, 100, "oov", 3.5), (0, 6, 100, "lr", 0.001),
                   (0, 7, 100, "acc", 0.9)]


def test_early_stop_patience(spark):
    vals = [1, 2, 3] + [2] * 12
    df = spark.createDataFrame([(0, i, i * 10, "bleu", float(v)) for i, v in enumerate(vals)],
                               "run int, line_no long, step long, key string, value double")
    r = one(logs.early_stop(df, "bleu", 10, width=4))
    assert r.stop_step == 12 * 10  # 3 is the best (index 2); index 12 is the 10th stale validation
    b = one(logs.best_step(df, "bleu"))
    assert (b.best_step, b.best_value) == (20, 3.0)


def test_empty_dev_lexicon_gives_null(spark):
    train = spark.createDataFrame([("a", 1)], "token string, n long")
    dev = spark.createDataFrame([], "token string, n long")
    r = one(stats.oov_stats(train, dev))
    assert (r.n_tokens, r.n_unique, r.p_oov, r.p_unique_oov) == (0, 0, None, None)
    toks = spark.createDataFrame([("t", "a")], "corpus string, token string")
    r = stats.oov_grid(toks, ["t"], ["d"]).collect()[0]
    assert r.n_tokens == 0 and r.oov is None


def test_decode_char_pieces_roundtrip(spark):
    df = spark.createDataFrame([("  hello   wörld \U0001F600 ",)], "s string")
    r = one(df.select(decode_pieces(char_pieces("s")).alias("d")))
    assert r.d == "hello wörld \U0001F600"


def test_token_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>")
    assert one(df.select(token_ngrams("t", 2)))[0] == ["a b", "b c"]
    assert one(df.select(token_ngrams("t", 4)))[0] == []
    assert one(df.select(F.size(metrics.ngram_strings("t", 3))))[0] == 1


def test_kl_matches_direct_formula(spark):
    a = {"ab": 3, "bc": 1}
    b = {"bc": 2, "cd": 5}
    keys = set(a) | set(b)
    p = {k: b.get(k, 0) + 1 for k in keys}
    q = {k: a.get(k, 0) + 1 for k in keys}
    sp, sq = sum(p.values()), sum(q.values())
    want = sum(p[k] / sp * math.log((p[k] / sp) / (q[k] / sq)) for k in keys)
    ta = spark.createDataFrame(list(a.items()), "gram string, n long")
    tb = spark.createDataFrame(list(b.items()), "gram string, n long")
    assert abs(one(stats.kl_divergence(ta, tb)).kl_dev_train - round(want, 6)) < 1e-9


def test_abbreviations_end_no_sentence(spark):
    from corpusforge.functions.rules import sentence_breaks
    df = spark.createDataFrame([("Mr. Smith met Prof. Dr. Jones. He left! Was No. 5 there? Yes.",)], "line string")
    assert one(df.select(sentence_breaks("line")))[0].split("\n") == [
        "Mr. Smith met Prof. Dr. Jones.", "He left!", "Was No. 5 there?", "Yes."]
