"""Corpus BLEU as a distributed job.

Hypothesis and reference are tokenised with the 13a rule chain, their 1..N
grams exploded with a side tag, counted per (pair, order, gram) — groups never
exceed one sentence — clipped with ``least``, then summed per order in one
small aggregate. The score is the standard corpus BLEU with brevity penalty
and 'exp' smoothing for orders without matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_of, tokens

# ---- fixed values: 13a tokenisation (ranges of ASCII punctuation) ---------
BLEU_13A = [
    (r"([{-~\[-\x60 -&(-+:-@/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def tokenise_13a(c) -> Column:
    s = col_of(c)
    s = F.replace(F.replace(F.replace(s, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit("")),
                  F.lit("\n"), F.lit(" "))
    for a, b in ENTITIES:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.concat(F.lit(" "), s, F.lit(" "))
    for pat, rep in BLEU_13A:
        s = F.regexp_replace(s, pat, rep)
    return tokens(s)


def ngram_strings(toks: str, n: int) -> Column:
    """All ``n``-grams of a token array as space-joined strings: one regex pass
    over the joined tokens with a zero-width lookahead at each token start."""
    joined = F.array_join(F.col(toks), " ")
    tail = "" if n == 1 else f"(?: [^ ]+){{{n - 1}}}"
    return F.regexp_extract_all(joined, F.lit(f"(?<![^ ])(?=([^ ]+{tail})(?![^ ]))"), 1)


def _bind(value: Column, body) -> Column:
    """``body`` over ``value`` evaluated once per row (a lambda variable is
    bound; an expression inside a lambda is evaluated for every element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbered(grams: Column) -> Column:
    """The grams in order, the k-th of equal ones marked with k: sets of them
    intersect as multisets do."""
    def mark(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def by_run(r: Column) -> Column:
            ends = F.concat(F.slice(r, 2, F.size(r)), F.array(n))
            counts = F.flatten(F.zip_with(r, ends, lambda a, b: F.sequence(F.lit(1), b - a)))
            return F.zip_with(s, counts, lambda g, k: F.concat_ws(" ", g, k.cast("string")))

        return F.when(n > 0, _bind(starts, by_run)).otherwise(s)

    return _bind(F.sort_array(grams), mark)


def bleu_counts(pairs: DataFrame, hyp: str = "hyp", ref: str = "ref", max_n: int = 4) -> DataFrame:
    """One row: ``sys_len, ref_len, matches_1..N, total_1..N``.

    A pair's clipped matches are counted inside its row, so that the one
    shuffle carries a row of sums per task and no n-gram."""
    t = pairs.select(tokenise_13a(hyp).alias("_h"), tokenise_13a(ref).alias("_r"))
    aggs = [F.sum(F.size("_h")).cast("long").alias("sys_len"), F.sum(F.size("_r")).cast("long").alias("ref_len")]
    for n in range(1, max_n + 1):
        own, other = ngram_strings("_h", n), ngram_strings("_r", n)
        matched = F.size(F.array_intersect(numbered(own), numbered(other)))
        aggs += [F.coalesce(F.sum(matched), F.lit(0)).cast("long").alias(f"matches_{n}"),
                 F.coalesce(F.sum(F.size(own)), F.lit(0)).cast("long").alias(f"total_{n}")]
    return t.agg(*aggs)


def bleu(pairs: DataFrame, key_cols: list[str], hyp: str = "hyp", ref: str = "ref", max_n: int = 4) -> DataFrame:
    """Corpus BLEU (0–100) in one row with its parts: ``bleu, bp, sys_len,
    ref_len, matches_1..N, total_1..N``; ``key_cols`` name the pairs."""
    row = bleu_counts(pairs, hyp, ref, max_n)
    # precisions with 'exp' smoothing: the k-th order without a match gets 1/2^k
    logs, zeros = [], F.lit(0)
    for n in range(1, max_n + 1):
        m, t = F.col(f"matches_{n}"), F.col(f"total_{n}")
        zeros = zeros + F.when((t > 0) & (m == 0), 1).otherwise(0)
        p = (F.when(t == 0, F.lit(0.0))
             .when(m == 0, F.lit(100.0) / (F.pow(F.lit(2.0), zeros) * t))
             .otherwise(F.lit(100.0) * m / t))
        logs.append(F.when(p > 0, F.log(p)).otherwise(F.lit(-9999999999.0)))
    # an order with no n-grams at all stops the sum (its precision stays 0)
    mean_log = sum(logs[1:], logs[0]) / F.lit(float(max_n))
    sys_len, ref_len = F.col("sys_len"), F.col("ref_len")
    bp = (F.when(sys_len >= ref_len, F.lit(1.0)).when(sys_len == 0, F.lit(0.0))
          .otherwise(F.exp(1 - ref_len.cast("double") / sys_len)))
    return row.select(F.round(bp * F.exp(mean_log), 6).alias("bleu"), F.round(bp, 6).alias("bp"),
                      sys_len.cast("long").alias("sys_len"), ref_len.cast("long").alias("ref_len"),
                      *[F.col(f"matches_{n}").cast("long") for n in range(1, max_n + 1)],
                      *[F.col(f"total_{n}").cast("long") for n in range(1, max_n + 1)])
