"""Subword vocabularies: word tables, character vocabularies, weighted pair
counts and numericalising (BPE itself is in ``bpe``).

BPE works on *types*: the word-frequency table (one row per distinct word,
with its symbols), never on the token stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import PIECE_SPACE, chars, tokens
from .bpe import SPECIALS
from .rows import map_values

#: Rows that a vocabulary sent to every task may have.
VOCAB_LIMIT = 1 << 21
# ids of the exported JSON vocabulary: end of sentence and unknown come first
EOS_ID, UNK_ID = 0, 1


def word_table(lines: DataFrame, text_col: str = "line", group_cols: list[str] | None = None) -> DataFrame:
    """Distinct words with frequency and initial symbols (characters, the
    first one marked as a word start)."""
    g = list(group_cols or [])
    words = (lines.select(*g, F.explode(tokens(text_col)).alias("word"))
             .groupBy(*g, "word").agg(F.count(F.lit(1)).cast("long").alias("freq")))
    marked = F.concat(F.lit(PIECE_SPACE), F.col("word"))
    syms = F.array_join(chars(marked), " ")
    return words.withColumn("syms", syms)


def char_vocab(lines: DataFrame, text_col: str = "line", coverage: float = 1.0,
               group_cols: list[str] | None = None) -> DataFrame:
    """Characters by frequency (spaces as word-start marks), cut where the
    cumulative share first reaches ``coverage``. Returns ``(group…, id, piece,
    n, score)``; ids follow the specials. The window runs over the character
    inventory (hundreds of rows per group), not over corpus rows."""
    g = list(group_cols or [])
    marked = F.concat(F.lit(PIECE_SPACE), F.array_join(tokens(text_col), PIECE_SPACE))
    counts = (lines.select(*g, F.explode(chars(marked)).alias("piece"))
              .groupBy(*g, "piece").agg(F.count(F.lit(1)).cast("long").alias("n")))
    order = Window.partitionBy(*g).orderBy(F.col("n").desc(), F.col("piece"))
    whole = Window.partitionBy(*g)
    ranked = (counts.withColumn("_rank", F.row_number().over(order))
              .withColumn("_total", F.sum("n").over(whole))
              .withColumn("_before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)),
                                                F.lit(0))))
    kept = ranked.where(F.col("_before") < F.col("_total") * F.lit(coverage))
    return kept.select(*g, (F.col("_rank") + len(SPECIALS) - 1).cast("int").alias("id"), "piece", "n",
                       F.round(F.log(F.col("n") / F.col("_total")), 6).alias("score"))


def pair_counts(words: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Weighted adjacent symbol pairs: ``(group…, left, right, n)``."""
    g = list(group_cols or [])
    # split once in a projection: an explode does not share repeated subexpressions
    split = words.select(*g, "freq", F.split(F.col("syms"), " ", -1).alias("_s"))
    s = F.col("_s")
    k = F.size(s) - 1
    zipped = F.arrays_zip(F.slice(s, 1, k).alias("l"), F.slice(s, 2, k).alias("r"))
    ex = split.where(F.size(s) > 1).select(*g, "freq", F.explode(zipped).alias("p"))
    return (ex.groupBy(*g, F.col("p.l").alias("left"), F.col("p.r").alias("right"))
            .agg(F.sum("freq").cast("long").alias("n")))


def numericalise(lines: DataFrame, vocab: DataFrame, id_cols: list[str], pieces_col: str = "pieces",
                 piece_col: str = "piece", id_col: str = "id", out_col: str = "ids") -> DataFrame:
    """Pieces → vocabulary ids (unknown → ``UNK_ID``), end-of-sentence id appended, as an id array per line.

    The vocabulary goes to every task as one map and is looked up inside the line: no piece is shuffled. It is bounded
    by its making (characters, or a vocabulary size); one of more than ``VOCAB_LIMIT`` rows raises ValueError.
    """
    # one id per piece: a later duplicate wins, as in ``vocab_to_json``
    found = vocab.groupBy(F.col(piece_col).alias("piece")).agg(F.max(id_col).cast("int").alias("id")).limit(VOCAB_LIMIT + 1).collect()
    if len(found) > VOCAB_LIMIT:
        raise ValueError(f"a vocabulary of more than {VOCAB_LIMIT} pieces")
    shared = lines.sparkSession.sparkContext.broadcast({r["piece"]: r["id"] for r in found})

    def make():
        ids = shared.value
        return lambda pieces: [*(ids.get(p, UNK_ID) for p in (pieces or "").split(" ") if p), EOS_ID]

    slim = lines.select(*dict.fromkeys([*id_cols, pieces_col]))
    return map_values(slim, F.col(pieces_col).cast("string"), out_col, T.ArrayType(T.IntegerType()), make).select(*id_cols, out_col)


def json_vocab_ids(vocab: DataFrame, piece_col: str = "piece") -> DataFrame:
    """Vocabulary rows after the specials get ids from 2 (``</s>``=0,
    ``<unk>``=1), in vocabulary order."""
    return (vocab.where(~F.col(piece_col).isin(SPECIALS))
            .select(F.col(piece_col).alias("piece"), (F.col("id") - len(SPECIALS) + 2).cast("int").alias("id")))
