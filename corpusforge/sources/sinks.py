"""Sinks: grid and size-table rendering, pair and vocabulary export.

Rendering is a projection over the (small) result DataFrame, so the same rows
feed ``write.csv``/``write.text`` on executors; nothing is printed from the
driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_rank(c, names: list[str]) -> Column:
    """0-based position of ``c`` in a fixed list; unknown names rank 0."""
    arr = F.array(*[F.lit(n) for n in names])
    pos = F.array_position(arr, F.col(c) if isinstance(c, str) else c)
    return F.coalesce(F.nullif(pos, F.lit(0)) - 1, F.lit(0)).cast("long")


def safe_name(key: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in key)


def format_grid(grid: DataFrame, value_col: str, row_col: str, col_col: str, cols: list[str],
                decimals: int = 2, row_order: list[str] | None = None) -> DataFrame:
    """Pivot a long grid to one row per ``row_col`` with one formatted cell per
    column key (``%.<decimals>f`` of the value rounded to ``decimals``), the
    custom row rank and a LaTeX row."""
    cell = F.format_string(f"%.{decimals}f", F.round(F.col(value_col), decimals))
    wide = grid.groupBy(row_col).pivot(col_col, cols).agg(F.first(cell))
    names = [safe_name(c) for c in cols]
    for c, n in zip(cols, names):
        wide = wide.withColumnRenamed(c, n)
    tex = F.concat(F.concat_ws(" & ", F.col(row_col), *[F.coalesce(F.col(n), F.lit("")) for n in names]),
                   F.lit(" \\\\"))
    return wide.select(row_col, order_rank(row_col, row_order or []).alias("rank"), *names, tex.alias("tex"))


def stats_rows(stats: DataFrame, name_col: str = "corpus") -> DataFrame:
    """LaTeX rows of the size table: name & lines & mean line length &
    mean token length & unique-token percentage."""
    row = F.concat(F.concat_ws(" & ", F.col(name_col), *[F.col(c).cast("string") for c in
                                                         ("n_lines", "mean_line_tokens", "mean_token_bytes",
                                                          "pct_unique")]),
                   F.lit(" \\\\"))
    return stats.select(name_col, row.alias("tex"))


# ---- fixed output values: head and foot of the size table in LaTeX ----------
TABLE_HEAD = ["\\begin{tabular}{lrrrr}", "\\toprule",
              "Corpus & Lines & Tokens per line & Bytes per token & Distinct tokens (\\%) \\\\", "\\midrule"]
TABLE_FOOT = ["\\bottomrule", "\\end{tabular}"]


def stats_table(stats: DataFrame, name_col: str = "corpus") -> DataFrame:
    """``(pos, line)``: the size table with head and foot, rows by name."""
    rows = stats_rows(stats, name_col).select(F.lit(1).alias("part"), F.col(name_col).alias("name"),
                                              F.lit(0).alias("nth"), F.col("tex").alias("line"))
    fixed = [(0, "", i, x) for i, x in enumerate(TABLE_HEAD)] + [(2, "", i, x) for i, x in enumerate(TABLE_FOOT)]
    both = rows.unionByName(stats.sparkSession.createDataFrame(fixed, "part int, name string, nth int, line string"))
    # one row per corpus
    return both.select((F.row_number().over(Window.orderBy("part", "name", "nth")) - 1).alias("pos"), "line")


def write_stats(stats: DataFrame, path: str, name_col: str = "corpus") -> None:
    """Write the size table as one LaTeX file."""
    stats_table(stats, name_col).orderBy("pos").select("line").coalesce(1).write.mode("overwrite").text(path)


def write_grid(formatted: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a formatted grid as CSV (header) or as LaTeX rows, in rank order."""
    ordered = formatted.orderBy("rank", formatted.columns[0])
    if fmt == "csv":
        ordered.drop("rank", "tex").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "tex":
        ordered.select("tex").coalesce(1).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_pairs(pairs: DataFrame, path: str, key_cols: list[str], src_col: str = "src",
                tgt_col: str = "tgt", partition_col: str | None = "split") -> None:
    """Write pairs as Parquet (the source of truth), partitioned by split and
    sorted by key within files; both sides stay in one row, so they can never
    fall out of alignment."""
    w = pairs.select(*key_cols, src_col, tgt_col, *([partition_col] if partition_col else []))
    writer = w.sortWithinPartitions(*key_cols).write.mode("overwrite")
    if partition_col:
        writer = writer.partitionBy(partition_col)
    writer.parquet(path)


def export_side(pairs: DataFrame, path: str, key_col: str, side_col: str, rows_per_file: int) -> None:
    """Export one side as text lines in key order, one file for every
    ``rows_per_file`` values of the dense key, under ``file=<key div
    rows_per_file>``. The file of a pair follows from its key alone, so both
    sides' files hold the same pairs in the same order whenever they are
    written."""
    numbered = pairs.select(F.floor(F.col(key_col) / F.lit(rows_per_file)).cast("long").alias("file"), F.col(key_col).alias("_key"),
                            F.coalesce(F.col(side_col), F.lit("")).alias("value"))
    (numbered.repartition("file").sortWithinPartitions("file", "_key").drop("_key")
     .write.mode("overwrite").partitionBy("file").text(path))


def vocab_to_json(vocab: DataFrame, piece_col: str = "piece", id_col: str = "id") -> DataFrame:
    """Vocabulary → one JSON object ``{piece: id}`` with ``</s>``=0 and
    ``<unk>``=1 (a later duplicate piece wins). The vocabulary is bounded by
    its configured size, so one row holding it is fine."""
    dedup = vocab.groupBy(piece_col).agg(F.max(id_col).alias(id_col))
    reserved = vocab.sparkSession.createDataFrame([("</s>", 0), ("<unk>", 1)], [piece_col, id_col])
    allv = dedup.where(~F.col(piece_col).isin("</s>", "<unk>")).unionByName(reserved)
    entries = F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col(piece_col).alias("p"))))
    m = F.map_from_arrays(F.transform(entries, lambda e: e["p"]), F.transform(entries, lambda e: e["i"]))
    return allv.agg(F.to_json(m).alias("json"))


def vocab_to_dict(vocab: DataFrame, piece_col: str = "piece", count: int = 100,
                  keep: list[str] | None = None) -> DataFrame:
    """Vocabulary → ``piece count`` lines for a fixed-count dictionary."""
    return vocab.select(*(keep or []), F.concat_ws(" ", F.col(piece_col), F.lit(str(count))).alias("line"))
