"""Line corpora: rows with a stable line identity.

A line corpus is ``(…keys, line_no, line)``. Text stored in a table is cut
into lines with ``posexplode(split(text, '\\n'))``; a line file is read with
``spark.read.text`` and numbered by offsets of its blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import index_by_int


def split_lines(text) -> "F.Column":
    """Lines of a text; a final newline does not open an empty last line."""
    t = F.col(text) if isinstance(text, str) else text
    parts = F.split(t, "\n", -1)
    return F.when(t.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def explode_lines(df: DataFrame, text_col: str = "text", pos_col: str = "line_in_doc",
                  line_col: str = "line") -> DataFrame:
    """One row per line, keeping every other column; ``pos_col`` is 0-based."""
    keep = [c for c in df.columns if c != text_col]
    # split once in a projection: an explode does not share repeated subexpressions
    parts = df.select(*keep, split_lines(text_col).alias("_lines"))
    return parts.select(*keep, F.posexplode("_lines").alias(pos_col, line_col))


def number_lines(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text",
                 partition_cols: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Explode documents into lines with a dense ``line_no`` per corpus.

    ``line_no`` = lines of all earlier documents of the same corpus (by
    ``doc_col``) + position in the document: what concatenating the documents
    into one file and numbering its lines would give, without a global window.
    """
    counted = docs.withColumn("_n_lines", F.size(split_lines(text_col)))
    offs = index_by_int(counted, doc_col, out="_doc_off", width=width, partition_cols=partition_cols, weight="_n_lines")
    lines = explode_lines(offs.drop("_n_lines"), text_col)
    return lines.withColumn("line_no", F.col("_doc_off") + F.col("line_in_doc")).drop("_doc_off")


def read_lines(spark: SparkSession, path: str, line_col: str = "line") -> DataFrame:
    """Read UTF-8 line files as ``(line_no, line)``, several files one after the other in the order of their paths.

    The scan says of every row which file and which block of it (a byte range) it comes from; blocks count their rows,
    block offsets are summed in the order of path and block start over that small table, and a row adds its index inside
    its block. So neither the sizes of the files nor how blocks are dealt to tasks matters. LF, CR-LF and CR end a line
    and one final newline opens no empty line, as in Python's text mode.
    """
    raw = spark.read.text(path)
    tagged = raw.select(F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_block"),
                        F.monotonically_increasing_id().alias("_mid"),
                        F.col("value").alias(line_col))
    counts = tagged.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    # one row per block: bounded by the number of file splits
    return (tagged.join(F.broadcast(offsets.select("_block", "_off", "_first")), "_block")
            .select((F.col("_off") + F.col("_mid") - F.col("_first")).alias("line_no"), line_col))
