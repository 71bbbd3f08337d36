"""Registered queries: each reads the shared tables at ``sf_dir`` in full and
returns a lazy DataFrame whose column names match its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import stats
from . import inputs as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


# ---------------------------------------------------------------- comparison

@query("lexicon")
def q_lexicon(spark, sf):
    return stats.lexicon(I.documents(spark, sf), "text", ["corpus"])


@query("char_ngrams")
def q_char_ngrams(spark, sf):
    return stats.char_ngrams(I.doc_lines(spark, sf), "line", 3, ["corpus"])


@query("oov_grid")
def q_oov_grid(spark, sf):
    toks = I.documents(spark, sf).select("corpus", F.explode(tokens("text")).alias("token"))
    return stats.oov_grid(toks, I.TRAIN_KEYS, I.DEV_KEYS)


@query("kl_grid")
def q_kl_grid(spark, sf):
    from ..functions.text import char_windows
    grams = I.doc_lines(spark, sf).select("corpus", F.explode(char_windows("line", 3)).alias("gram"))
    return stats.kl_grid(grams, I.TRAIN_KEYS, I.DEV_KEYS)


def _lang_lexicons(spark, sf):
    lex = stats.lexicon(I.documents(spark, sf), "text", ["split", "lang"])
    train = lex.where(F.col("split") == "train").drop("split")
    dev = lex.where(F.col("split") == "dev").drop("split")
    return train, dev


@query("oov_stats")
def q_oov_stats(spark, sf):
    train, dev = _lang_lexicons(spark, sf)
    return stats.oov_stats(train, dev, ["lang"])


@query("oov_tokens")
def q_oov_tokens(spark, sf):
    train, dev = _lang_lexicons(spark, sf)
    return stats.oov_tokens(train, dev, ["lang"]).select("lang", "token", F.col("n").cast("long"))


@query("sample_oov")
def q_sample_oov(spark, sf):
    train, dev = _lang_lexicons(spark, sf)
    oov = stats.oov_tokens(train, dev, ["lang"])
    return stats.sample_oov(oov, 20, I.SEED, ["lang"]).select("lang", "rank", "token", F.col("n").cast("long"))


@query("vocab_setops")
def q_vocab_setops(spark, sf):
    train, dev = _lang_lexicons(spark, sf)
    return stats.vocab_setops(train, dev, ["lang"])


@query("kl_divergence")
def q_kl_divergence(spark, sf):
    prof = stats.char_ngrams(I.doc_lines(spark, sf), "line", 3, ["split", "lang"])
    train = prof.where(F.col("split") == "train").drop("split")
    dev = prof.where(F.col("split") == "dev").drop("split")
    return stats.kl_divergence(train, dev, group_cols=["lang"])


@query("corpus_stats")
def q_corpus_stats(spark, sf):
    return stats.corpus_stats(I.doc_lines(spark, sf), "line", ["corpus"])


@query("unique_tokens")
def q_unique_tokens(spark, sf):
    return stats.unique_tokens(I.doc_lines(spark, sf), "line", ["corpus"])


@query("line_counts")
def q_line_counts(spark, sf):
    return stats.line_counts(I.doc_lines(spark, sf), ["lang", "split"])


@query("corpus_lines")
def q_corpus_lines(spark, sf):
    from ..sources.lines import number_lines
    lines = number_lines(I.documents(spark, sf), "doc_id", "text", ["corpus"])
    return lines.select("corpus", "doc_id", F.col("line_in_doc").cast("long"), "line_no", "line")


@query("grid_export")
def q_grid_export(spark, sf):
    from ..sources.sinks import format_grid
    grid = q_kl_grid(spark, sf)
    return format_grid(grid, "kl_dev_train", "train", "dev", I.DEV_KEYS, 2, row_order=I.TRAIN_KEYS)


@query("stats_export")
def q_stats_export(spark, sf):
    from ..sources.sinks import stats_rows
    return stats_rows(q_corpus_stats(spark, sf), "corpus")


# ------------------------------------------------------------ corpus building

def _line_ids(df):
    return df.withColumn("line_id", F.concat_ws(":", F.col("doc_id").cast("string"),
                                                F.col("line_in_doc").cast("string")))


def _lang_corpus(spark, sf, lang):
    """Lines of one language as a line file: ``line_no, line``."""
    from ..sources.lines import number_lines
    docs = I.documents(spark, sf).where(F.col("lang") == lang)
    return number_lines(docs, "doc_id", "text").select("line_no", "line")


@query("shuffle_rows")
def q_shuffle_rows(spark, sf):
    from ..operators.sampling import shuffle_positions
    docs = I.documents(spark, sf).select("doc_id")
    return shuffle_positions(docs, "doc_id", I.SEED, "pos")


@query("head_rows")
def q_head_rows(spark, sf):
    from ..operators.sampling import head
    return head(I.documents(spark, sf).select("doc_id", "lang"), 100, "doc_id", I.SEED)


@query("tail_rows")
def q_tail_rows(spark, sf):
    from ..operators.sampling import head
    return head(I.documents(spark, sf).select("doc_id", "lang"), 100, "doc_id", I.SEED, last=True)


@query("split_corpus")
def q_split_corpus(spark, sf):
    from ..operators.sampling import split_corpus
    lines = _line_ids(I.doc_lines(spark, sf).select("doc_id", "line_in_doc"))
    out = split_corpus(lines, "line_id", 4096, 4096, I.SEED)
    return out.select("doc_id", F.col("line_in_doc").cast("long"), "split")


@query("reshuffle_split")
def q_reshuffle_split(spark, sf):
    from ..operators.sampling import resplit
    docs = I.documents(spark, sf).select("doc_id", "split")
    train = docs.where(F.col("split") == "train").drop("split")
    valid = docs.where(F.col("split") == "dev").drop("split")
    return resplit(train, valid, "doc_id", seed=7)


@query("size_matched_subsample")
def q_size_matched_subsample(spark, sf):
    from ..operators.sampling import subsample_to
    from ..sources.lines import number_lines
    lines = number_lines(I.documents(spark, sf), "doc_id", "text", ["source"])
    ref = lines.where(F.col("source") == "src0")
    out = subsample_to(lines, ref, "line_no", "split", ["source"])
    return out.select("source", "doc_id", F.col("line_in_doc").cast("long"), "split")


@query("bernoulli_sample")
def q_bernoulli_sample(spark, sf):
    from ..operators.sampling import sample_ratio
    from ..sources.lines import number_lines
    lines = _line_ids(number_lines(I.documents(spark, sf), "doc_id", "text", ["lang"]))
    out = sample_ratio(lines, 0.3, "line_id", I.SEED, "line", "line_no")
    return out.select("lang", "doc_id", F.col("line_in_doc").cast("long"))


@query("concat_corpora")
def q_concat_corpora(spark, sf):
    p = I.pairs(spark, sf)
    src = p.select("conv_id", "turn", F.lit("src").alias("side"), F.col("src").alias("text"))
    tgt = p.select("conv_id", "turn", F.lit("tgt").alias("side"), F.col("tgt").alias("text"))
    return src.unionByName(tgt)


@query("augment_mix")
def q_augment_mix(spark, sf):
    from ..operators.sampling import augment_mix
    nat = I.pairs(spark, sf)
    syn = nat.select("conv_id", "turn", F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    return augment_mix(syn, nat, 2).select("origin", "copy", "conv_id", "turn", "src", "tgt")


@query("tsv_pairs")
def q_tsv_pairs(spark, sf):
    from ..sources.align import tsv_field
    c = I.table(spark, sf, "conversations")
    tsv = I.pairs(spark, sf).select("conv_id", "turn", F.concat_ws("\t", "src", "tgt").alias("line"))
    no_tab = c.where(F.col("role") == "system").select("conv_id", "turn", F.col("text").alias("line"))
    lines = tsv.unionByName(no_tab)
    return lines.select("conv_id", "turn", tsv_field("line", 1).alias("f1"), tsv_field("line", 2).alias("f2"))


@query("paste_align")
def q_paste_align(spark, sf):
    from ..sources.align import paste
    return paste(_lang_corpus(spark, sf, "fr"), _lang_corpus(spark, sf, "en"))


@query("zip_align")
def q_zip_align(spark, sf):
    from ..sources.align import zip_lines
    en = _lang_corpus(spark, sf, "en").withColumn("label", F.lit("__label__en"))
    es = _lang_corpus(spark, sf, "es")
    return zip_lines("line_no", (en, "line", "src"), (en, "label", "src_label"), (es, "line", "tgt"))


@query("swap_direction")
def q_swap_direction(spark, sf):
    from ..sources.align import canonical, paste
    a = paste(_lang_corpus(spark, sf, "en"), _lang_corpus(spark, sf, "fr"))
    a = a.select("line_no", F.lit("en").alias("src_lang"), F.lit("fr").alias("tgt_lang"), "src", "tgt")
    b = paste(_lang_corpus(spark, sf, "es"), _lang_corpus(spark, sf, "de"))
    b = b.select("line_no", F.lit("es").alias("src_lang"), F.lit("de").alias("tgt_lang"), "src", "tgt")
    return canonical(a.unionByName(b))


@query("build_parallel")
def q_build_parallel(spark, sf):
    from ..plans.composites import build_parallel
    return build_parallel(_lang_corpus(spark, sf, "fr"), _lang_corpus(spark, sf, "en"), "fr", "en",
                          n_val=4096, n_dev=4096, seed=I.SEED)


# ------------------------------------------------------------------ filtering

def _lid_model(spark, sf):
    from ..operators.lid import lid_fit
    train = I.doc_lines(spark, sf).where(F.col("split") == "train")
    return lid_fit(train, "lang", "line", 3)


@query("lid_fit")
def q_lid_fit(spark, sf):
    grams, langs = _lid_model(spark, sf)
    return (grams.join(langs, "lang")
            .select("lang", "gram", "n", F.round(F.col("ln_c1") - F.col("ln_denominator"), 6).alias("logp")))


@query("lid_predict")
def q_lid_predict(spark, sf):
    from ..operators.lid import lid_predict
    lines = I.doc_lines(spark, sf).select("doc_id", "line_in_doc", "lang", "line")
    pred = lid_predict(lines, _lid_model(spark, sf), ["doc_id", "line_in_doc"], "line")
    return (lines.select("doc_id", "line_in_doc", "lang").join(pred, ["doc_id", "line_in_doc"])
            .select("doc_id", F.col("line_in_doc").cast("long"), "lang", "pred", "pred_score"))


def _training_pairs(spark, sf):
    """The same recipe with val and dev small enough to leave training rows on small tables too."""
    from ..plans.composites import build_parallel
    return build_parallel(_lang_corpus(spark, sf, "fr"), _lang_corpus(spark, sf, "en"), "fr", "en",
                          n_val=512, n_dev=512, seed=I.SEED)


@query("lid_filter")
def q_lid_filter(spark, sf):
    from ..plans.composites import filter_languages
    return filter_languages(_training_pairs(spark, sf), "fr", "en", _lid_model(spark, sf))


@query("clean_pairs")
def q_clean_pairs(spark, sf):
    from ..operators.filters import clean_pairs
    return clean_pairs(I.pairs(spark, sf), splits=None).select("conv_id", "turn")


@query("mono_length")
def q_mono_length(spark, sf):
    from ..operators.filters import max_tokens
    lines = I.doc_lines(spark, sf)
    return (max_tokens(lines, "line", 100, True, splits=("train",))
            .select("doc_id", F.col("line_in_doc").cast("long"), "split"))


@query("truncate_tokens")
def q_truncate_tokens(spark, sf):
    from ..functions.text import char_pieces, truncate_tokens
    lines = I.doc_lines(spark, sf).select("doc_id", "line_in_doc", char_pieces("line").alias("pieces"))
    return lines.select("doc_id", F.col("line_in_doc").cast("long"),
                        truncate_tokens("pieces", 1022).alias("pieces"))


@query("encoded_length")
def q_encoded_length(spark, sf):
    from ..functions.text import char_pieces
    from ..operators.filters import drop_oversize, piece_count
    p = I.pairs(spark, sf)
    enc = p.select("conv_id", "turn", (piece_count(char_pieces("src")) + 1).alias("src_len"),
                   (piece_count(char_pieces("tgt")) + 1).alias("tgt_len"))
    return drop_oversize(enc, "src_len", "tgt_len", 1024).select(
        "conv_id", "turn", F.col("src_len").cast("long"), F.col("tgt_len").cast("long"))


# ------------------------------------------------------------------ text jobs

def _tok_lines(spark, sf):
    from ..functions.rules import normalise_tokenise
    lines = I.doc_lines(spark, sf)
    return lines.withColumn("tok", normalise_tokenise("line", "lang"))


@query("normalise_tokenise")
def q_normalise_tokenise(spark, sf):
    return _tok_lines(spark, sf).select("doc_id", F.col("line_in_doc").cast("long"), "tok")


@query("detokenise")
def q_detokenise(spark, sf):
    from ..functions.rules import detokenise
    t = _tok_lines(spark, sf)
    return t.select("doc_id", F.col("line_in_doc").cast("long"), detokenise("tok", "lang").alias("text"))


def _abbreviations(spark, sf):
    from ..operators.sentences import abbreviation_fit
    return abbreviation_fit(I.doc_lines(spark, sf).where(F.col("split") == "train"), "line", "lang")


@query("sentence_fit")
def q_sentence_fit(spark, sf):
    return _abbreviations(spark, sf)


@query("sentence_split")
def q_sentence_split(spark, sf):
    from ..operators.sentences import split_sentences
    lines = I.doc_lines(spark, sf).select("doc_id", "line_in_doc", "lang", "line")
    return (split_sentences(lines, _abbreviations(spark, sf))
            .select("doc_id", F.col("line_in_doc").cast("long"), F.col("sent_no").cast("long"), "sentence"))


def _truecase_model(spark, sf):
    from ..operators.truecase import truecase_fit
    return truecase_fit(_tok_lines(spark, sf).where(F.col("split") == "train"), "tok", ["lang"])


@query("truecase_fit")
def q_truecase_fit(spark, sf):
    return _truecase_model(spark, sf).select("lang", "lc", "form", "n", "is_best")


@query("truecase_apply")
def q_truecase_apply(spark, sf):
    from ..operators.truecase import truecase_apply, truecase_fit
    from ..session import checkpoint_dir
    checkpoint_dir(spark)
    tok = _tok_lines(spark, sf).select("doc_id", "line_in_doc", "lang", "split", "tok").checkpoint()  # fitted on and cased
    model = truecase_fit(tok.where(F.col("split") == "train"), "tok", ["lang"])
    out = truecase_apply(tok, model, ["doc_id", "line_in_doc", "lang"], "tok", "text", group_cols=["lang"])
    return out.select("doc_id", F.col("line_in_doc").cast("long"), "text")


@query("detruecase")
def q_detruecase(spark, sf):
    from ..operators.truecase import detruecase
    t = _tok_lines(spark, sf)
    return t.select("doc_id", F.col("line_in_doc").cast("long"), detruecase(F.lower("tok")).alias("text"))


@query("postprocess")
def q_postprocess(spark, sf):
    from ..plans.composites import postprocess
    from ..functions.text import char_pieces
    t = _tok_lines(spark, sf).select("doc_id", "line_in_doc", "lang", char_pieces(F.lower("tok")).alias("hyp"))
    return postprocess(t, "hyp", "lang").select("doc_id", F.col("line_in_doc").cast("long"), "text")


# -------------------------------------------------------------------- metrics

@query("bleu")
def q_bleu(spark, sf):
    from ..operators.metrics import bleu
    p = I.pairs(spark, sf).select("conv_id", "turn", F.col("src").alias("hyp"), F.col("tgt").alias("ref"))
    return bleu(p, ["conv_id", "turn"], "hyp", "ref")


def _decoder_log(spark, sf):
    """A decoder log for the pairs: a source line and a hypothesis line (id,
    score, pieces) for each, as a decoder prints them."""
    from ..functions.rules import normalise_tokenise
    from ..functions.text import char_pieces
    p = I.pairs(spark, sf).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    pieces = char_pieces(F.lower(normalise_tokenise("src")))
    s_line = F.concat(F.lit("S-"), F.col("id"), F.lit("\t"), F.col("src"))
    h_line = F.concat(F.lit("H-"), F.col("id"), F.lit("\t-0.5\t"), pieces)
    return p.select(F.explode(F.array(s_line, h_line)).alias("line"))


@query("score_dev")
def q_score_dev(spark, sf):
    from ..plans.composites import score_dev
    refs = I.pairs(spark, sf).select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("tgt").alias("ref"))
    return score_dev(_decoder_log(spark, sf), refs, "en")


def _logs(spark, sf):
    e = I.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    step = F.concat(F.lit("[2020] Ep. 1 : Up. "), F.col("event_id").cast("string"), F.lit(" : Sen. 64,000 : Cost "),
                    F.col("value").cast("string"), F.lit(" : Time 3.1s : L.r. 3.0e-04"))
    one = F.concat(F.col("event_type"), F.lit(" : "), F.col("value").cast("string"), F.lit(" :"))
    several = F.concat(F.lit("n_lines: "), F.col("event_id").cast("string"), F.lit(", "), F.col("value").cast("string"),
                       F.lit(" % of oov tokens : acc : 0.5 : "), one)
    line = (F.when(F.col("event_id") % 100 == 0, step).when(F.col("event_id") % 100 == 50, several)
            .otherwise(F.concat(F.lit(": "), one)))
    return e.select((F.col("user_id") % 4).alias("run"), F.col("event_id").alias("line_no"), line.alias("line"))


@query("log_scalars")
def q_log_scalars(spark, sf):
    from ..operators.logs import log_scalars
    return log_scalars(_logs(spark, sf))


@query("best_checkpoint")
def q_best_checkpoint(spark, sf):
    from ..operators.logs import best_step, log_scalars
    return best_step(log_scalars(_logs(spark, sf)), "purchase")


@query("early_stop")
def q_early_stop(spark, sf):
    from ..operators.logs import early_stop, log_scalars
    return early_stop(log_scalars(_logs(spark, sf)), "purchase", 10)


# -------------------------------------------------------------------- subword

def _train_tok(spark, sf):
    return _tok_lines(spark, sf).where(F.col("split") == "train")


@query("char_vocab")
def q_char_vocab(spark, sf):
    from ..operators.subword import char_vocab
    return char_vocab(_train_tok(spark, sf), "tok", 1.0, ["lang"])


@query("bpe_pair_counts")
def q_bpe_pair_counts(spark, sf):
    from ..operators.subword import pair_counts, word_table
    return pair_counts(word_table(_train_tok(spark, sf), "tok", ["lang"]), ["lang"])


BPE_VOCAB = 16_000


def _bpe(tok):
    from ..operators.bpe import bpe_learn
    from ..operators.subword import word_table
    return bpe_learn(word_table(tok.where(F.col("split") == "train"), "tok"), BPE_VOCAB)


def _kept_tok_lines(spark, sf):
    """Tokenised lines that are learnt from and encoded: tokenised once."""
    from ..session import checkpoint_dir
    checkpoint_dir(spark)
    return _tok_lines(spark, sf).select("doc_id", "line_in_doc", "split", "tok").checkpoint()


@query("bpe_learn")
def q_bpe_learn(spark, sf):
    vocab, _ = _bpe(_tok_lines(spark, sf))
    return vocab.select("id", "piece", "kind", "rank", "n")


@query("subword_encode")
def q_subword_encode(spark, sf):
    from ..functions.text import char_pieces
    t = _tok_lines(spark, sf)
    return t.select("doc_id", F.col("line_in_doc").cast("long"), char_pieces("tok").alias("pieces"))


@query("subword_encode_bpe")
def q_subword_encode_bpe(spark, sf):
    from ..operators.bpe import bpe_encode
    tok = _kept_tok_lines(spark, sf)
    vocab, _ = _bpe(tok)
    out = bpe_encode(tok.select("doc_id", "line_in_doc", "tok"), vocab, "tok", "pieces")
    return out.select("doc_id", F.col("line_in_doc").cast("long"), "pieces")


@query("numericalise")
def q_numericalise(spark, sf):
    from ..functions.text import char_pieces
    from ..operators.subword import char_vocab, json_vocab_ids, numericalise
    tok = _tok_lines(spark, sf)
    vocab = json_vocab_ids(char_vocab(tok.where(F.col("split") == "train"), "tok", 1.0))
    lines = tok.select("doc_id", "line_in_doc", char_pieces("tok").alias("pieces"))
    out = numericalise(lines, vocab, ["doc_id", "line_in_doc"], "pieces")
    return out.select("doc_id", F.col("line_in_doc").cast("long"), F.array_join("ids", " ").alias("ids"))


@query("segment_corpus")
def q_segment_corpus(spark, sf):
    from ..plans.composites import segment_corpus
    out = segment_corpus(_kept_tok_lines(spark, sf), ["doc_id", "line_in_doc"], "tok", BPE_VOCAB)
    return out.select("doc_id", F.col("line_in_doc").cast("long"), "split",
                      F.size("ids").cast("long").alias("n_ids"), F.array_join("ids", " ").alias("ids"))


# ---------------------------------------------------------------- composites

@query("preprocess_corpus")
def q_preprocess_corpus(spark, sf):
    from ..plans.composites import preprocess_corpus
    pairs = _training_pairs(spark, sf)
    return preprocess_corpus(pairs, "fr", "en", _lid_model(spark, sf)).select("line_no", "split", "src", "tgt")


@query("recipe_monolingual")
def q_recipe_monolingual(spark, sf):
    """Sentences of the training lines, shuffled, through the monolingual preparation."""
    from ..plans.composites import monolingual_recipe
    lines = I.doc_lines(spark, sf).select("doc_id", "line_in_doc", "lang", "split", "line")
    return monolingual_recipe(lines, ["doc_id", "line_in_doc"]).select(
        "doc_id", F.col("line_in_doc").cast("long"), F.col("sent_no").cast("long"), "lang", "split", F.col("pos").cast("long"), "text")


@query("preprocess_monolingual")
def q_preprocess_monolingual(spark, sf):
    from ..plans.composites import preprocess_monolingual
    lines = I.doc_lines(spark, sf).select("doc_id", "line_in_doc", "lang", "split", "line")
    out = preprocess_monolingual(lines, ["doc_id", "line_in_doc"], "line")
    return out.select("doc_id", F.col("line_in_doc").cast("long"), "lang", "split", "text")


# -------------------------------------------------------- vocabulary files

def _vocab_file(spark, sf):
    """The character vocabulary of the training lines written as a
    vocabulary file would be: three special rows, then ``piece \\t score`` in
    id order, numbered from 0."""
    from ..operators.subword import SPECIALS, char_vocab
    tok = _tok_lines(spark, sf).where(F.col("split") == "train")
    v = char_vocab(tok, "tok", 1.0).select("id", F.concat_ws("\t", "piece", F.col("score").cast("string")).alias("line"))
    specials = spark.createDataFrame([(i, f"{p}\t0") for i, p in enumerate(SPECIALS)], "id int, line string")
    return specials.unionByName(v).select(F.col("id").cast("long").alias("line_no"), "line")


@query("vocab_read")
def q_vocab_read(spark, sf):
    from ..sources.align import read_vocab
    return read_vocab(_vocab_file(spark, sf)).select("id", "piece", F.round("score", 6).alias("score"))


@query("vocab_dict")
def q_vocab_dict(spark, sf):
    from ..sources.align import read_vocab
    from ..sources.sinks import vocab_to_dict
    v = read_vocab(_vocab_file(spark, sf))
    return vocab_to_dict(v.select("id", "piece"), keep=["id"])


@query("vocab_json")
def q_vocab_json(spark, sf):
    from ..sources.align import read_vocab
    from ..sources.sinks import vocab_to_json
    v = read_vocab(_vocab_file(spark, sf))
    made = vocab_to_json(v.withColumn("id", F.col("id") + 2))
    return made.select(F.explode(F.from_json("json", "map<string,int>")).alias("piece", "id"))


@query("write_pairs")
def q_write_pairs(spark, sf):
    """Pairs written by split to the shared folder and read back."""
    import uuid

    from ..operators.sampling import split_corpus
    from ..session import checkpoint_dir
    from ..sources.sinks import write_pairs
    p = I.pairs(spark, sf).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/pairs-{uuid.uuid4()}"
    write_pairs(split_corpus(p, "id", 100, 100, I.SEED), path, ["id"])
    return spark.read.parquet(path).select("id", "split", "src", "tgt")


# ------------------------------------------------------- registry, relabel

@query("relabel_split")
def q_relabel_split(spark, sf):
    """Source split names mapped to ours after a re-split (``valid`` → ``val``)."""
    from ..sources.align import relabel_split
    return relabel_split(q_reshuffle_split(spark, sf), {"valid": "val", "test": "dev"})


@query("corpus_registry")
def q_corpus_registry(spark, sf):
    """Every source of ``documents`` registered as a corpus (role by the seeded
    split), read through the registry and counted."""
    from ..sources.registry import join_registered
    role = F.explode(F.array(F.lit("train"), F.lit("dev"))).alias("role")
    name = F.concat_ws(":", "source", "role")
    reg = (I.table(spark, sf, "documents").select("source").distinct().select("source", role)
           .select(name.alias("name"), "role", name.alias("path"), F.lit("xx").alias("src"), F.lit("xx").alias("tgt")))
    lines = I.doc_lines(spark, sf).select("source", "split", "line")
    read = join_registered(lines, reg, F.concat_ws(":", "source", "split"))
    return read.groupBy("corpus", "role").agg(F.count(F.lit(1)).cast("long").alias("n_lines"))


# ------------------------------------------------------------------ recipes

def _pasted(spark, sf, a, b):
    from ..sources.align import paste
    return paste(_lang_corpus(spark, sf, a), _lang_corpus(spark, sf, b))


@query("recipe_concatenated")
def q_recipe_concatenated(spark, sf):
    from .recipes import concatenated
    return concatenated({"fr-en": _pasted(spark, sf, "fr", "en"), "es-de": _pasted(spark, sf, "es", "de")},
                        n_val=512, n_dev=512, seed=I.SEED).select("origin", "id", "split", "src", "tgt")


@query("recipe_resampled")
def q_recipe_resampled(spark, sf):
    from ..functions.keys import hash_unit
    from .recipes import resampled
    pairs = _pasted(spark, sf, "fr", "en")
    valid = hash_unit("line_no", I.SEED) < I.DEV_FRACTION
    return resampled(pairs.where(~valid), pairs.where(valid), 0.3, seed=7).select("line_no", "split", "src", "tgt")


@query("recipe_size_matched")
def q_recipe_size_matched(spark, sf):
    from ..operators.sampling import split_corpus
    from .recipes import size_matched
    big = split_corpus(_pasted(spark, sf, "fr", "en"), "line_no", 512, 512, I.SEED)
    small = split_corpus(_pasted(spark, sf, "es", "de"), "line_no", 512, 512, I.SEED)
    return size_matched(big, small).select("line_no", "split")


@query("recipe_evaluation_only")
def q_recipe_evaluation_only(spark, sf):
    from .recipes import evaluation_only
    model = _truecase_model(spark, sf)
    one = [model.where(F.col("lang") == x) for x in ("fr", "en")]
    return evaluation_only(q_build_parallel(spark, sf), "fr", "en", tuple(one)).select("line_no", "split", "src", "tgt")


def _segmented(spark, sf, joint, **how):
    from ..operators.sampling import split_corpus
    from .composites import segment_parallel
    p = I.pairs(spark, sf).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    out = segment_parallel(split_corpus(p, "id", 50, 50, I.SEED).select("id", "split", "src", "tgt"), ["id"], "char", "char", joint=joint, **how)
    return out.select("id", "side", "split", F.size("ids").cast("long").alias("n_ids"), F.array_join("ids", " ").alias("ids"))


@query("segment_chars")
def q_segment_chars(spark, sf):
    return _segmented(spark, sf, joint=False)


@query("segment_chars_joint")
def q_segment_chars_joint(spark, sf):
    return _segmented(spark, sf, joint=True)


@query("segment_capped")
def q_segment_capped(spark, sf):
    """Each side's characters learnt on 100 training lines of it, picked at random; every line is segmented."""
    return _segmented(spark, sf, joint=False, max_sentences=100)
