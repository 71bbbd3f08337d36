"""Column-level text functions (no Python in the row path).

Everything here returns a ``Column`` built from Spark's own expressions, so it
stays inside whole-stage code generation and runs the same on batch and
streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split() separators: Unicode White_Space plus the four
# information separators U+001C..U+001F.
WS_PATTERN = r"(?U)[\s\x1c-\x1f]+"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c) -> Column:
    """Whitespace tokens of a string, no empty tokens (``str.split()``)."""
    return F.array_remove(F.split(col_of(c), WS_PATTERN, -1), "")


def space_tokens(c) -> Column:
    """Tokens of already tokenised text (single spaces between tokens)."""
    return F.array_remove(F.split(col_of(c), " ", -1), "")


def char_windows(c, n: int = 3, newline: bool = True) -> Column:
    """Sliding windows of ``n`` code points over a line.

    The line keeps its terminating newline (``newline=True``), as lines read
    from a file do. A line shorter than ``n`` yields one window: the short
    string itself, which can never equal a full ``n``-gram.

    One left-to-right regex pass captures every overlapping window in
    O(length): each match consumes exactly one code point and looks ahead for
    the window (a zero-width match would also stop inside a surrogate pair).
    Indexing code points with ``substring`` would rescan the string for every
    position.
    """
    s = F.concat(col_of(c), F.lit("\n")) if newline else col_of(c)
    grams = F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{n}}}))."), 1)
    # at least n code points <=> at least one window; testing the length keeps
    # the regex to one evaluation even where no subexpression reuse applies
    return F.when(F.length(s) >= n, grams).otherwise(F.array(s))


def token_ngrams(toks, n: int) -> Column:
    """Space-joined token ``n``-grams of an array (empty when too short)."""
    t = col_of(toks)
    grams = F.transform(F.sequence(F.lit(1), F.size(t) - F.lit(n - 1)),
                        lambda i: F.array_join(F.slice(t, i, n), " "))
    return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))


# Separators for the unique-token count of the size table: these six
# punctuation characters become spaces, then runs of space/newline split.
UNIQUE_PUNCT = ':;,?!"'


def punct_split_tokens(c) -> Column:
    """Tokens for the unique-token statistic: punctuation mapped to space,
    split on runs of space or newline, the empty token dropped."""
    s = F.translate(col_of(c), UNIQUE_PUNCT, " " * len(UNIQUE_PUNCT))
    return F.filter(F.split(s, "[ \n]+", -1), lambda t: t != F.lit(""))


def truncate_tokens(c, n: int) -> Column:
    """First ``n`` space-separated fields (``cut -d' ' -f1-n``)."""
    parts = F.split(col_of(c), " ", -1)
    return F.array_join(F.slice(parts, 1, n), " ")


def strip_bpe_marks(c) -> Column:
    """Remove ``@@ `` continuation marks."""
    return F.regexp_replace(col_of(c), "@@ ", "")


PIECE_SPACE = "▁"


def decode_pieces(c) -> Column:
    """Pieces → text: drop the separators, word-start marks become spaces."""
    s = F.replace(F.replace(col_of(c), F.lit(" "), F.lit("")), F.lit(PIECE_SPACE), F.lit(" "))
    return F.ltrim(s)


def chars(c) -> Column:
    """Code points of a string (a supplementary character stays whole)."""
    return F.array_remove(F.split(col_of(c), "", -1), "")


def char_pieces(c) -> Column:
    """Character segmentation: word-start mark on the first char of each word."""
    s = F.concat(F.lit(PIECE_SPACE), F.array_join(tokens(c), PIECE_SPACE))
    return F.array_join(chars(s), " ")
