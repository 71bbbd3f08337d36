"""Alignment of line corpora by line number, positional TSV fields, label and
decoder-log parsing, direction handling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import read_lines


def paste(a: DataFrame, b: DataFrame, key: str = "line_no", a_col: str = "line", b_col: str = "line",
          names: tuple[str, str] = ("src", "tgt")) -> DataFrame:
    """Pair two corpora by line number; the shorter side is padded with ''."""
    left = a.select(key, F.col(a_col).alias(names[0]))
    right = b.select(key, F.col(b_col).alias(names[1]))
    j = left.join(right, key, "full_outer")
    return j.select(key, F.coalesce(F.col(names[0]), F.lit("")).alias(names[0]),
                    F.coalesce(F.col(names[1]), F.lit("")).alias(names[1]))


def zip_lines(key: str, *sides: tuple[DataFrame, str, str]) -> DataFrame:
    """Strict alignment: inner join of ``(df, column, new_name)`` sides on the
    line number; stops at the shortest input."""
    frames = [df.select(key, F.col(c).alias(name)) for df, c, name in sides]
    return reduce(lambda x, y: x.join(y, key), frames)


def tsv_field(line, i: int, missing: str = "line") -> Column:
    """Field ``i`` (1-based) of a tab-separated line.

    ``missing='line'``: a line without a tab yields the whole line for every
    field (what ``cut -f`` does without ``-s``); ``'null'``: NULL; ``'empty'``:
    '' for absent fields.
    """
    s = F.col(line) if isinstance(line, str) else line
    parts = F.split(s, "\t", -1)
    field = F.when(F.size(parts) >= i, F.element_at(parts, i))
    if missing == "line":
        return F.when(F.size(parts) == 1, s).otherwise(F.coalesce(field, F.lit("")))
    if missing == "empty":
        return F.coalesce(field, F.lit(""))
    if missing == "null":
        return F.when(F.size(parts) > 1, field)
    raise ValueError(missing)


def read_tsv(spark: SparkSession, path: str, names: list[str], fields: list[int] | None = None,
             missing: str = "line") -> DataFrame:
    """Positional TSV file → ``(line_no, *names)``; no header, no quoting."""
    lines = read_lines(spark, path, "line")
    idx = fields or list(range(1, len(names) + 1))
    return lines.select("line_no", *[tsv_field("line", i, missing).alias(n) for i, n in zip(idx, names)])


LABEL_PREFIX = "__label__"


def parse_label(c, suffix2: bool = False) -> Column:
    """Language of a ``__label__xx`` prediction; ``suffix2`` keeps only the
    last two letters (so ``__label__ceb`` reads as ``eb``)."""
    s = F.col(c) if isinstance(c, str) else c
    if suffix2:
        return F.substring(s, -2, 2)
    return F.when(s.startswith(LABEL_PREFIX), F.substring(s, len(LABEL_PREFIX) + 1, 1 << 20))


def read_hypotheses(log: DataFrame, line_col: str = "line", key: str = "line_no") -> DataFrame:
    """Decoder output: keep lines starting with ``H``, take the third field."""
    return (log.where(F.col(line_col).startswith("H"))
            .select(key, F.element_at(F.split(line_col, "\t", -1), 3).alias("hyp")))


def read_vocab(lines: DataFrame, line_col: str = "line", key: str = "line_no", specials: int = 3) -> DataFrame:
    """``piece \\t score`` lines → ``(id, piece, score)``: the first ``specials``
    rows are skipped and ids follow file order from 0."""
    parts = F.split(line_col, "\t", -1)
    return (lines.where(F.col(key) >= specials)
            .select((F.col(key) - specials).cast("int").alias("id"),
                    F.element_at(parts, 1).alias("piece"),
                    F.element_at(parts, 2).cast("double").alias("score")))


def canonical(pairs: DataFrame, src_lang: str = "src_lang", tgt_lang: str = "tgt_lang",
              src: str = "src", tgt: str = "tgt", english_target: bool = False) -> DataFrame:
    """One direction per language pair: alphabetical order (or English as the
    target with ``english_target``); reversed rows are swapped, not copied."""
    sl, tl = F.col(src_lang), F.col(tgt_lang)
    if english_target:
        swap = (sl == "en") & (tl != "en")
    else:
        swap = sl > tl
    return pairs.select(*[c for c in pairs.columns if c not in (src_lang, tgt_lang, src, tgt)],
                        F.when(swap, tl).otherwise(sl).alias(src_lang),
                        F.when(swap, sl).otherwise(tl).alias(tgt_lang),
                        F.when(swap, F.col(tgt)).otherwise(F.col(src)).alias(src),
                        F.when(swap, F.col(src)).otherwise(F.col(tgt)).alias(tgt))


def reverse(pairs: DataFrame, src_lang: str = "src_lang", tgt_lang: str = "tgt_lang",
            src: str = "src", tgt: str = "tgt") -> DataFrame:
    """The other direction as a projection."""
    return pairs.withColumnsRenamed({src_lang: "_sl", tgt_lang: src_lang, src: "_s", tgt: src}) \
        .withColumnsRenamed({"_sl": tgt_lang, "_s": tgt})


def relabel_split(df: DataFrame, mapping: dict[str, str], split_col: str = "split") -> DataFrame:
    """Rename source split names (``test`` → ``dev`` …); unknown names stay."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(split_col, F.coalesce(F.element_at(m, F.col(split_col)), F.col(split_col)))
