"""Helpers shared by the operators: tables, label folds, seeded keys, lineage cuts, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.session import checkpoint_dir

#: Classes of characters that separate words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n (null for a null key)."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def hex_key(seed: str, *parts: Column) -> Column:
    """md5 hex of the seed and the parts as text, joined by ':' (null parts read ``null``)."""
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))


def hex_number(text: Column, digits: int) -> Column:
    """The first hex digits as a whole number (at most 15 digits)."""
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once per row: a lambda variable is bound, an expression would be
    evaluated again for every element of a higher-order function that mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's shared checkpoint folder, so that later stages reread it
    even if executors are lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(df: DataFrame, read: Sequence[str]) -> DataFrame:
    """The columns that an operator reads, and all others as the struct ``row``, whose names then meet no name of the
    operator's own."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in read]
    return df.select(*read, (F.struct(*rest) if rest else F.lit(None).cast("string")).alias("row"))


def unpacked(df: DataFrame, read: Sequence[str], but: Sequence[str] = ()) -> list[Column]:
    """The columns of ``df`` (but some), to be selected from its packed form."""
    return [F.col(c) if c in read else F.col(f"row.`{c}`") for c in df.columns if c not in but]


def map_rows(df: DataFrame, run: Callable, *extra: T.StructField) -> DataFrame:
    """``df.mapInArrow(run)`` whose rows keep all columns, whatever their names, and gain ``extra`` ones; in ``run``
    columns go by position, named ``_0``, ``_1`` and so on."""
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *extra])).toDF(*df.columns, *(f.name for f in extra))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int,
                    seed: str) -> DataFrame:
    """(doc_id, label, text, rank): for each of the labels 0 and 1 the ``per_class`` labelled documents that
    come first in a seeded order, among ids for which ``keep`` holds. The sample is chosen on the slim labels
    table; its ids, at most ``2 * per_class``, are broadcast to fetch the texts. A doc_id labelled twice takes
    its larger label, a doc_id with several texts the smallest; null ids, labels and texts are left out."""
    known = (labels.where(keep & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))
    order = hex_key(seed, F.col("doc_id"))
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).withColumn("rank", order).orderBy("rank", "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    return (docs.select("doc_id", "text").where(F.col("text").isNotNull())
            .join(F.broadcast(picked), "doc_id")
            .groupBy("doc_id", "label", "rank").agg(F.min("text").alias("text")))
