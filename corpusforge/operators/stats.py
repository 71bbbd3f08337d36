"""Corpus comparison: lexicons, character n-gram profiles, OOV and KL grids,
size statistics.

Grid plans are single-pass: counts per token (or gram) and corpus with map-side
partial aggregation, totals per corpus, and for the pairs only the items that two
corpora share. No per-pair re-scan, no collect of a lexicon, and a hot token
costs one partial-aggregate row per map task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hash_key
from ..functions.text import char_windows, punct_split_tokens, tokens

ROUND = 6


def lexicon(df: DataFrame, text_col: str = "text", group_cols: list[str] | None = None) -> DataFrame:
    """Token counts per corpus: ``(group…, token, n)``."""
    g = list(group_cols or [])
    return (df.select(*g, F.explode(tokens(text_col)).alias("token"))
            .groupBy(*g, "token").agg(F.count(F.lit(1)).alias("n")))


def char_ngrams(lines: DataFrame, line_col: str = "line", n: int = 3,
                group_cols: list[str] | None = None) -> DataFrame:
    """Character ``n``-gram counts per corpus, each line with its newline."""
    g = list(group_cols or [])
    return (lines.select(*g, F.explode(char_windows(line_col, n)).alias("gram"))
            .groupBy(*g, "gram").agg(F.count(F.lit(1)).alias("n")))


def _shared(counts: DataFrame, train: list[str], dev: list[str], smoothing: int) -> DataFrame:
    """``(train, dev, shared, shared_n, shared_log)`` from item counts ``(_item, _corpus, _n)``: for each pair the items
    that both have, their dev count, and Σ dev count · ln(train count + smoothing).

    An item brings the list of the corpora that have it (at most one entry a corpus); a batch of such lists is two
    matrices, items by train and by dev corpora, and their products are the sums of all pairs."""
    place = {k: i for i, k in enumerate(dict.fromkeys([*train, *dev]))}
    at = F.create_map(*[x for k, i in place.items() for x in (F.lit(k), F.lit(i))])[F.col("_corpus")]
    lists = counts.groupBy("_item").agg(F.collect_list(F.struct(at.alias("i"), F.col("_n").cast("double").alias("n"))).alias("c"))
    lists = lists.where(F.size("c") > 1 if not set(train) & set(dev) else F.lit(True)).select("c.i", "c.n")
    t_at, d_at = [place[k] for k in train], [place[k] for k in dev]

    def run(batches):
        both = np.zeros((3, len(d_at), len(t_at)))
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):  # bounds the dense matrices
                some = batch.slice(start, 2048)
                rows = np.repeat(np.arange(some.num_rows), pc.list_value_length(some.column(0)).to_numpy())
                table = np.zeros((some.num_rows, len(place)))
                table[rows, some.column(0).flatten().to_numpy()] = some.column(1).flatten().to_numpy()
                t, d = table[:, t_at], table[:, d_at]
                has = (t > 0).astype(float)
                both += (d > 0).astype(float).T @ has, d.T @ has, d.T @ np.where(t > 0, np.log(t + smoothing), 0.0)
        j, i = (x.ravel() for x in np.indices(both.shape[1:]))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(b.ravel()) for b in both)], ["t", "d", "a", "b", "c"])

    parts = lists.mapInArrow(run, "t int, d int, a double, b double, c double")
    names = [F.array(*map(F.lit, x)) for x in (train, dev)]
    return parts.groupBy("t", "d").agg(*[F.sum(c).alias(c) for c in "abc"]).select(
        F.get(names[0], F.col("t")).alias("train"), F.get(names[1], F.col("d")).alias("dev"),
        F.col("a").cast("long").alias("shared"), F.col("b").cast("long").alias("shared_n"), F.col("c").alias("shared_log"))


def _grid(stream: DataFrame, item_col: str, key_col: str, weight: str | None, train: list[str], dev: list[str], smoothing: int = 1) -> DataFrame:
    """One row a pair of names: the totals of both corpora (``t_`` and ``d_``: distinct items, their number, and sums of
    logarithms) and what they share. The plan is of one size, whatever the number of corpora."""
    keys = list(dict.fromkeys([*train, *dev]))
    spark = stream.sparkSession
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    known = F.broadcast(spark.createDataFrame([(k,) for k in keys], "_corpus string"))  # the names asked for
    counts = (stream.select(F.col(item_col).alias("_item"), F.col(key_col).alias("_corpus"), w.alias("_w")).join(known, "_corpus")
              .groupBy("_item", "_corpus").agg(F.sum("_w").alias("_n")).where("_n > 0"))
    n, s = F.col("_n"), F.lit(float(smoothing))
    totals = counts.groupBy("_corpus").agg(F.count(F.lit(1)).alias("items"), F.sum(n).alias("n"), F.sum(F.log(n + s)).alias("log"),
                                           F.sum((n + s) * F.log(n + s)).alias("nlog"))

    def side(name: str, names: list[str]) -> DataFrame:
        listed = spark.createDataFrame([(k,) for k in dict.fromkeys(names)], f"{name} string")
        filled = [F.coalesce(F.col(c), F.lit(0)).alias(f"{name[0]}_{c}") for c in ("items", "n", "log", "nlog")]
        return listed.join(totals, F.col(name) == F.col("_corpus"), "left").select(name, *filled)

    pairs = side("train", train).crossJoin(F.broadcast(side("dev", dev)))  # the cells of the grid; a row a name that was asked for
    out = pairs.join(_shared(counts, list(dict.fromkeys(train)), list(dict.fromkeys(dev)), smoothing), ["train", "dev"], "left")
    return out.fillna(0, ["shared", "shared_n", "shared_log"])


def oov_grid(token_stream: DataFrame, train: list[str], dev: list[str],
             key_col: str = "corpus", token_col: str = "token", weight: str | None = None) -> DataFrame:
    """OOV statistics for every (train, dev) pair in one pass.

    ``token_stream`` holds ``(key_col, token_col[, weight])``: raw tokens, or a
    lexicon with its count as ``weight``. Keys are corpus names; ``train`` and
    ``dev`` name the two roles. What a pair lacks is the dev corpus without what
    both share. Returns ``train, dev, n_oov, n_tokens, n_unique_oov, n_unique,
    oov, unique_oov`` (percent, NULL for an empty dev lexicon).
    """
    out = _grid(token_stream, token_col, key_col, weight, train, dev).select(
        "train", "dev", (F.col("d_n") - F.col("shared_n")).cast("long").alias("n_oov"), F.col("d_n").cast("long").alias("n_tokens"),
        (F.col("d_items") - F.col("shared")).cast("long").alias("n_unique_oov"), F.col("d_items").cast("long").alias("n_unique"))
    return (out.withColumn("oov", F.round(100.0 * F.try_divide(F.col("n_oov").cast("double"), F.col("n_tokens")), ROUND))
            .withColumn("unique_oov", F.round(100.0 * F.try_divide(F.col("n_unique_oov").cast("double"),
                                                                   F.col("n_unique")), ROUND)))


def kl_grid(gram_stream: DataFrame, train: list[str], dev: list[str], key_col: str = "corpus",
            gram_col: str = "gram", weight: str | None = None, smoothing: int = 1) -> DataFrame:
    """KL(dev ‖ train) of smoothed n-gram distributions for every pair, one pass.

    Per pair the support is the union of the two corpora's grams, every count
    gets ``+smoothing``. With A = train+s, B = dev+s over that union,
    KL = Σ B·ln(B/A) / ΣB + ln(ΣA / ΣB). By inclusion and exclusion these sums
    need each corpus's own totals and, of the pair, only the grams both have.
    """
    s = float(smoothing)
    g = _grid(gram_stream, gram_col, key_col, weight, train, dev, smoothing)
    union = F.col("t_items") + F.col("d_items") - F.col("shared")
    only_dev = F.col("d_items") - F.col("shared")
    b_ln_b = F.col("d_nlog") + (union - F.col("d_items")) * F.lit(s * math.log(s))
    b_ln_a = F.lit(s) * F.col("t_log") + F.col("shared_log") + (F.col("d_n") - F.col("shared_n") + s * only_dev) * F.lit(math.log(s))
    sa, sb = F.col("t_n") + s * union, F.col("d_n") + s * union
    kl = F.try_divide(b_ln_b - b_ln_a, sb) + F.log(F.try_divide(sa, sb))
    return g.select("train", "dev", union.cast("long").alias("n_grams"), F.round(kl, ROUND).alias("kl_dev_train"))


def kl_divergence(train_counts: DataFrame, dev_counts: DataFrame, gram_col: str = "gram",
                  n_col: str = "n", smoothing: int = 1, group_cols: list[str] | None = None) -> DataFrame:
    """KL(dev ‖ train) of two count tables, per group: full outer join of the
    keys (missing count = 0), ``+smoothing`` on the union, one aggregate."""
    g = list(group_cols or [])
    j = (train_counts.select(*g, gram_col, F.col(n_col).alias("_a"))
         .join(dev_counts.select(*g, gram_col, F.col(n_col).alias("_b")), g + [gram_col], "full_outer"))
    s = float(smoothing)
    A = F.coalesce("_a", F.lit(0)) + s
    B = F.coalesce("_b", F.lit(0)) + s
    agg = j.groupBy(*g).agg(F.sum(A).alias("sa"), F.sum(B).alias("sb"), F.sum(B * F.log(B / A)).alias("sbl"),
                            F.count(F.lit(1)).alias("n_grams"))
    return agg.select(*g, F.col("n_grams").cast("long"),
                      F.round(F.col("sbl") / F.col("sb") + F.log(F.col("sa") / F.col("sb")), ROUND)
                      .alias("kl_dev_train"))


def oov_stats(train_lex: DataFrame, dev_lex: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """``(n_oov, p_oov, n_unique_oov, p_unique_oov)`` per group: dev lexicon
    left-joined to the train lexicon's keys."""
    g = list(group_cols or [])
    known = train_lex.select(*g, "token").withColumn("_known", F.lit(True))
    j = dev_lex.join(known, g + ["token"], "left")
    miss = F.col("_known").isNull()
    out = j.groupBy(*g).agg(
        F.coalesce(F.sum(F.when(miss, F.col("n"))), F.lit(0)).cast("long").alias("n_oov"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_tokens"),
        F.count_if(miss).cast("long").alias("n_unique_oov"),
        F.count(F.lit(1)).cast("long").alias("n_unique"))
    return (out.withColumn("p_oov", F.round(F.try_divide(F.col("n_oov").cast("double"), F.col("n_tokens")), ROUND))
            .withColumn("p_unique_oov",
                        F.round(F.try_divide(F.col("n_unique_oov").cast("double"), F.col("n_unique")), ROUND)))


def oov_tokens(train_lex: DataFrame, dev_lex: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Dev tokens (with counts) missing from the train lexicon: anti join."""
    g = list(group_cols or [])
    return dev_lex.join(train_lex.select(*g, "token"), g + ["token"], "left_anti")


def sample_oov(oov: DataFrame, n: int = 20, seed: int = 42, group_cols: list[str] | None = None) -> DataFrame:
    """``n`` OOV tokens per group in seeded random order (a top-k per group:
    Spark keeps only the first ``n`` per group before the shuffle)."""
    g = list(group_cols or [])
    w = Window.partitionBy(*g).orderBy(hash_key("token", seed), "token")
    return (oov.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .withColumn("rank", F.col("rank").cast("long")))


def vocab_setops(a_lex: DataFrame, b_lex: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Sizes of key union and both differences of two lexicons per group."""
    g = list(group_cols or [])
    a = a_lex.select(*g, "token").distinct().withColumn("_a", F.lit(1))
    b = b_lex.select(*g, "token").distinct().withColumn("_b", F.lit(1))
    j = a.join(b, g + ["token"], "full_outer")
    return j.groupBy(*g).agg(
        F.count_if(F.col("_a").isNotNull()).cast("long").alias("n_a"),
        F.count_if(F.col("_b").isNotNull()).cast("long").alias("n_b"),
        F.count(F.lit(1)).cast("long").alias("n_union"),
        F.count_if(F.col("_b").isNull()).cast("long").alias("n_a_minus_b"),
        F.count_if(F.col("_a").isNull()).cast("long").alias("n_b_minus_a"))


def corpus_stats(lines: DataFrame, line_col: str = "line", group_cols: list[str] | None = None) -> DataFrame:
    """The size table: lines, tokens, bytes (with newlines), integer means and
    the unique-token percentage, per corpus; also true code-point counts.

    Unique tokens use the punctuation-to-space split; the percentage divides
    by the whitespace token count, as the original table does.
    """
    g = list(group_cols or [])
    base = lines.select(*g, F.size(tokens(line_col)).alias("_nt"),
                        (F.octet_length(line_col) + 1).alias("_nb"),
                        (F.length(line_col) + 1).alias("_nc"))
    sizes = base.groupBy(*g).agg(F.count(F.lit(1)).cast("long").alias("n_lines"),
                                 F.sum("_nt").cast("long").alias("n_tokens"),
                                 F.sum("_nb").cast("long").alias("n_bytes"),
                                 F.sum("_nc").cast("long").alias("n_chars"))
    uniq = unique_tokens(lines, line_col, g)
    out = sizes.join(uniq, g, "left") if g else sizes.crossJoin(uniq)
    return out.select(*g, "n_lines", "n_tokens", "n_bytes", "n_chars",
                      F.try_divide(F.col("n_tokens"), F.col("n_lines")).cast("long").alias("mean_line_tokens"),
                      F.try_divide(F.col("n_bytes"), F.col("n_tokens")).cast("long").alias("mean_token_bytes"),
                      "n_unique",
                      F.try_divide(100 * F.col("n_unique"), F.col("n_tokens")).cast("long").alias("pct_unique"))


def unique_tokens(lines: DataFrame, line_col: str = "line", group_cols: list[str] | None = None,
                  approx: bool = False) -> DataFrame:
    """Distinct punctuation-split tokens per corpus (exact: two-level agg;
    ``approx``: HyperLogLog sketch, one pass)."""
    g = list(group_cols or [])
    toks = lines.select(*g, F.explode(punct_split_tokens(line_col)).alias("_t"))
    if approx:
        return toks.groupBy(*g).agg(F.approx_count_distinct("_t").cast("long").alias("n_unique"))
    return toks.distinct().groupBy(*g).agg(F.count(F.lit(1)).cast("long").alias("n_unique"))


def line_counts(lines: DataFrame, group_cols: list[str]) -> DataFrame:
    return lines.groupBy(*group_cols).agg(F.count(F.lit(1)).cast("long").alias("n_lines"))
