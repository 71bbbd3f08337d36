"""Composite jobs: each is one lazy plan over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import split_corpus
from ..sources.align import canonical, paste
from ..sources.stages import Stages


def build_parallel(src_lines: DataFrame, tgt_lines: DataFrame, src_lang: str, tgt_lang: str,
                   n_val: int = 4096, n_dev: int = 4096, seed: int = 42,
                   english_target: bool = True) -> DataFrame:
    """Two aligned line files → shuffled val/dev/train pairs in canonical
    direction: paste → seeded exact-size split → direction swap."""
    pairs = paste(src_lines, tgt_lines)
    split = split_corpus(pairs, "line_no", n_val, n_dev, seed)
    out = split.select("line_no", "split", F.lit(src_lang).alias("src_lang"),
                       F.lit(tgt_lang).alias("tgt_lang"), "src", "tgt")
    return canonical(out, english_target=english_target)


def postprocess(df: DataFrame, pieces_col: str, lang_col: str, out_col: str = "text") -> DataFrame:
    """Decoder pieces → text: decode pieces, strip continuation marks,
    detruecase, detokenise — one projection."""
    from ..functions.rules import detokenise
    from ..functions.text import decode_pieces, strip_bpe_marks
    from ..operators.truecase import detruecase
    text = detokenise(detruecase(strip_bpe_marks(decode_pieces(pieces_col))), lang_col)
    return df.withColumn(out_col, text)


def score_dev(decoder_log: DataFrame, refs: DataFrame, lang: str, line_col: str = "line",
              id_col: str = "id", ref_col: str = "ref") -> DataFrame:
    """Decoder log → hypotheses (``H`` lines, third field; id from the first)
    → post-processing → pairing with references by id → corpus BLEU.

    A reference without a hypothesis is scored against an empty one; a
    hypothesis without a reference cannot be scored. ``unmatched_refs`` and
    ``unmatched_hyps`` count them, so a partial log shows in the result."""
    from ..operators.metrics import bleu
    parts = F.split(F.col(line_col), "\t", -1)
    hyps = (decoder_log.where(F.col(line_col).startswith("H"))
            .select(F.substring(F.element_at(parts, 1), 3, 1 << 30).alias(id_col),
                    F.element_at(parts, 3).alias("pieces"), F.lit(lang).alias("_lang")))
    text = postprocess(hyps, "pieces", "_lang", "hyp")
    both = (text.select(id_col, "hyp", F.lit(True).alias("_h"))
            .join(refs.select(id_col, ref_col, F.lit(True).alias("_r")), id_col, "full_outer"))
    counts = both.agg(F.count_if(F.col("_r").isNull()).cast("long").alias("unmatched_hyps"),
                      F.count_if(F.col("_h").isNull()).cast("long").alias("unmatched_refs"))
    scored = both.where("_r").select(id_col, F.coalesce("hyp", F.lit("")).alias("hyp"), ref_col)
    return bleu(scored, [id_col], "hyp", ref_col).crossJoin(counts)  # one row each


def segment_corpus(lines: DataFrame, id_cols: list[str], text_col: str, vocab_size: int,
                   split_col: str = "split",
                   learn_splits: tuple[str, ...] = ("train",), max_sentences: int | None = None,
                   seed: int = 42, id_col: str | None = None, kind: str = "bpe") -> DataFrame:
    """Learn a vocabulary of characters or BPE pieces (``kind``) on the training
    lines (all, or a seeded random choice of ``max_sentences``), encode every
    split, numericalise with reserved ids. Returns ``(id…, split, pieces, ids)``.
    A character vocabulary holds every character; ``vocab_size`` is for BPE."""
    from ..functions.text import char_pieces
    from ..operators.sampling import head
    from ..operators.bpe import bpe_encode, bpe_learn
    from ..operators.subword import char_vocab, json_vocab_ids, numericalise, word_table
    train = lines.where(F.col(split_col).isin(list(learn_splits)))
    if max_sentences is not None:
        key = id_col or "_sid"
        keyed = train if id_col else train.withColumn("_sid", F.concat_ws(":", *[F.col(c).cast("string")
                                                                                 for c in id_cols]))
        train = head(keyed, max_sentences, key, seed)
    if kind == "char":
        vocab = char_vocab(train, text_col, 1.0)
        enc = lines.select(*id_cols, split_col, char_pieces(text_col).alias("pieces"))
    elif kind == "bpe":
        vocab, _ = bpe_learn(word_table(train, text_col), vocab_size)
        enc = bpe_encode(lines.select(*id_cols, split_col, text_col), vocab, text_col, "pieces").drop(text_col)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return numericalise(enc, json_vocab_ids(vocab), [*id_cols, split_col, "pieces"], "pieces")


def segment_parallel(pairs: DataFrame, id_cols: list[str], src_kind: str, tgt_kind: str,
                     src_size: int | None = None, tgt_size: int | None = None, joint: bool = False,
                     split_col: str = "split", **how) -> DataFrame:
    """Segment both sides of a parallel corpus: ``(id…, side, split, pieces, ids)``.

    A joint vocabulary is learned on both sides together and needs one kind and
    one size (``check_joint``); otherwise each side learns its own."""
    from ..sources.registry import check_joint
    sides = F.array(*[F.struct(F.lit(x).alias("side"), F.col(x).alias("text")) for x in ("src", "tgt")])
    lines = (pairs.select(*id_cols, split_col, F.explode(sides).alias("x"))
             .select(*id_cols, split_col, "x.side", "x.text"))
    keys = [*id_cols, "side"]
    if joint:
        check_joint(src_kind, tgt_kind, src_size, tgt_size)
        return segment_corpus(lines, keys, "text", src_size, split_col=split_col, kind=src_kind, **how)
    out = [segment_corpus(lines.where(F.col("side") == side), keys, "text", size, split_col=split_col, kind=kind, **how)
           for side, kind, size in (("src", src_kind, src_size), ("tgt", tgt_kind, tgt_size))]
    return out[0].unionByName(out[1])


def filter_languages(pairs: DataFrame, src_lang: str, tgt_lang: str, lid_model, id_col: str = "line_no",
                     split_col: str = "split", filter_splits: tuple[str, ...] = ("train",)) -> DataFrame:
    """``(id, split, src, tgt)`` without the rows of ``filter_splits`` whose
    sides are not predicted to be in their languages (a NULL side is in none).

    Both sides are predicted inside the pair's row, in one pass; of the other
    splits only an empty line is.
    """
    from ..operators.filters import lid_filter
    from ..operators.lid import label_of, lid_predict
    kept = [id_col, split_col, "src", "tgt"]
    chosen = F.coalesce(F.col(split_col).isin(list(filter_splits)), F.lit(False))
    df = pairs.select(*kept, *[F.when(chosen, F.col(c)).otherwise(F.lit("")).alias(f"_{c}") for c in ("src", "tgt")])
    df = lid_predict(df, lid_model, [id_col], "_src", out="_src_lang", carry=[split_col, "src", "tgt", "_tgt"])
    df = lid_predict(df, lid_model, [id_col], "_tgt", out="_tgt_lang", carry=[split_col, "src", "tgt", "_src_lang"])
    df = df.withColumn("src_label", label_of("_src_lang")).withColumn("tgt_label", label_of("_tgt_lang"))
    return lid_filter(df, src_lang, tgt_lang, splits=filter_splits, split_col=split_col).select(*kept)


def _kept(df: DataFrame, stages: Stages | None, name: str, params: dict) -> DataFrame:
    """A table that later steps read more than once."""
    if stages is not None:
        return stages.table(name, params, lambda: df)
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def monolingual_recipe(lines: DataFrame, id_cols: list[str], text_col: str = "line", lang_col: str = "lang", split_col: str = "split",
                       fit_splits: tuple[str, ...] = ("train",), seed: int = 42, stages: Stages | None = None) -> DataFrame:
    """The whole monolingual recipe: lines of the fitted splits → sentences, at boundaries learnt on them per language →
    shuffled, each split with positions of its own → ``preprocess_monolingual``. Lines of other splits stay lines.
    Returns ``(id…, sent_no, lang, split, pos, text)``."""
    from ..operators.ordering import exclusive_prefix_sum
    from ..functions.keys import hash_bucket, hash_key
    from ..operators.sentences import abbreviation_fit, split_sentences
    chosen = F.coalesce(F.col(split_col).isin(list(fit_splits)), F.lit(False))
    slim = lines.select(*id_cols, lang_col, split_col, text_col)
    fitted = slim.where(chosen)
    sents = split_sentences(fitted, abbreviation_fit(fitted, text_col, lang_col), text_col, lang_col, "sent_no", text_col)
    rows = sents.unionByName(slim.where(~chosen).withColumn("sent_no", F.lit(0)))
    ids = [*id_cols, "sent_no"]
    rows = rows.withColumn("_id", F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ids]))
    done = preprocess_monolingual(rows.select("_id", *ids, lang_col, split_col, text_col), ["_id", *ids], text_col, lang_col, split_col, fit_splits, stages=stages)
    keyed = done.withColumn("_order", hash_key("_id", seed))
    placed = exclusive_prefix_sum(keyed, ["_order", "_id"], hash_bucket("_id", seed, 4), out="pos", partition_cols=[split_col])
    return placed.select(*ids, lang_col, split_col, "pos", "text")


def preprocess_corpus(pairs: DataFrame, src_lang: str, tgt_lang: str, lid_model=None, id_col: str = "line_no",
                      split_col: str = "split", filter_splits: tuple[str, ...] = ("train",),
                      min_len: int = 1, max_len: int = 100, ratio: float = 1.8,
                      truecase_models: tuple[DataFrame, DataFrame] | None = None,
                      stages: Stages | None = None) -> DataFrame:
    """Parallel corpus preparation as one plan: language filter (filtered
    splits only, labels from ``lid_model``; skipped when None) → normalise and
    tokenise both sides → length/ratio cleaning (filtered splits) → truecaser
    fitted on the filtered splits per side (or the given models, e.g. one
    fitted on another corpus) → truecasing of every split.

    The tokenised table feeds both the fit and the apply, so it is kept: as a
    stage table, which later runs read, or without ``stages`` as a checkpoint.
    """
    from ..functions.rules import normalise_tokenise
    from ..operators.filters import clean_pairs
    df = pairs.select(id_col, split_col, "src", "tgt")
    if lid_model is not None:
        df = filter_languages(df, src_lang, tgt_lang, lid_model, id_col, split_col, filter_splits)
    df = (df.withColumn("_sl", F.lit(src_lang)).withColumn("_tl", F.lit(tgt_lang))
          .select(id_col, split_col, F.explode(F.array(F.struct(normalise_tokenise("src", "_sl").alias("src"),
                                                                normalise_tokenise("tgt", "_tl").alias("tgt")))).alias("_x"))
          .select(id_col, split_col, "_x.src", "_x.tgt"))  # exploded, so that the filter is not worked out on rules of its own
    df = clean_pairs(df, "src", "tgt", min_len, max_len, ratio, splits=filter_splits, split_col=split_col)
    df = _kept(df, stages, "tokenised_pairs", {"langs": [src_lang, tgt_lang], "lid": lid_model is not None, "splits": list(filter_splits),
                                               "limits": [min_len, max_len, ratio]})
    # both sides in one table: one fit (per side), one apply, one pivot back
    from ..operators.truecase import truecase_apply, truecase_fit
    stacked = (df.select(id_col, split_col, F.lit("src").alias("side"), F.col("src").alias("text"))
               .unionByName(df.select(id_col, split_col, F.lit("tgt").alias("side"), F.col("tgt").alias("text"))))
    if truecase_models is None:
        model = truecase_fit(stacked.where(F.col(split_col).isin(list(filter_splits))), "text", ["side"])
    else:
        sm, tm = truecase_models
        model = (sm.select("lc", "form", "n").withColumn("side", F.lit("src"))
                 .unionByName(tm.select("lc", "form", "n").withColumn("side", F.lit("tgt"))))
    tc = truecase_apply(stacked, model, [id_col, split_col, "side"], "text", "text", group_cols=["side"])
    return tc.groupBy(id_col, split_col).agg(F.max(F.when(F.col("side") == "src", F.col("text"))).alias("src"),
                                             F.max(F.when(F.col("side") == "tgt", F.col("text"))).alias("tgt"))


def preprocess_monolingual(lines: DataFrame, id_cols: list[str], text_col: str = "line", lang_col: str = "lang",
                           split_col: str = "split", fit_splits: tuple[str, ...] = ("train",),
                           max_fields: int = 100, stages: Stages | None = None) -> DataFrame:
    """Monolingual preparation: normalise and tokenise → fewer than
    ``max_fields`` tokens on the fitted splits (empty lines stay) →
    truecaser per language fitted on those splits → truecasing of every
    split. Returns ``(id…, lang, split, text)``."""
    from ..functions.rules import normalise_tokenise
    from ..operators.filters import max_tokens
    from ..operators.truecase import truecase_apply, truecase_fit
    # exploded, so that the filter on the tokens is not worked out on rules of its own
    df = lines.select(*id_cols, lang_col, split_col, F.explode(F.array(normalise_tokenise(text_col, lang_col))).alias("tok"))
    df = max_tokens(df, "tok", max_fields, True, splits=fit_splits, split_col=split_col)
    df = _kept(df, stages, "tokenised_lines", {"splits": list(fit_splits), "max_fields": max_fields, "ids": id_cols})
    model = truecase_fit(df.where(F.col(split_col).isin(list(fit_splits))), "tok", [lang_col])
    return truecase_apply(df, model, id_cols + [lang_col, split_col], "tok", "text", group_cols=[lang_col])
