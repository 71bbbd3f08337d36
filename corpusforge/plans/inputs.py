"""Derive the corpus inputs of every job from the shared tables.

The jobs operate on line corpora and parallel pairs; the tables hold
documents, conversations and event logs. These derivations are the same
whether the tables hold a thousand rows or a billion (no sampling, no caps):

* documents → lines, one corpus per language; train/dev by a seeded hash of
  ``doc_id`` (a fifth goes to dev);
* conversations → parallel pairs: user turn *t* ↔ assistant turn *t+1*;
* events → training-log lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import hash_unit
from ..sources.lines import explode_lines

SEED = 42
DEV_FRACTION = 0.2
LANGS = ["de", "en", "es", "fr"]
TRAIN_KEYS = [f"train:{lang}" for lang in LANGS]
DEV_KEYS = [f"dev:{lang}" for lang in LANGS]


#: Setting of a session: into how many parts each table is dealt by its key after reading. Local sessions set it, since
#: a test table is one row group and would be worked on by one task; on a cluster it stays unset, and tables are read as
#: their files are split.
SCAN_PARTS = "spark.corpusforge.scanParts"
TABLE_KEYS = {"documents": "doc_id", "conversations": "conv_id", "events": "event_id", "labels": "doc_id",
              "pages": "page_id", "benchmark": "item_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a shared table, dealt into the parts that the session asks for."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get(SCAN_PARTS, None)
    return df.repartition(int(parts), TABLE_KEYS[name]) if parts and name in TABLE_KEYS else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, text, split``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    split = F.when(hash_unit("doc_id", SEED) < F.lit(DEV_FRACTION), F.lit("dev")).otherwise(F.lit("train"))
    return d.withColumn("split", split).withColumn("corpus", F.concat_ws(":", "split", "lang"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, split, corpus, line_in_doc, line``."""
    return explode_lines(documents(spark, sf_dir), "text")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel pairs ``conv_id, turn, src, tgt``: each user turn with the
    assistant turn that answers it (equi-join on ``conv_id`` and turn + 1)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("src"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("tgt"))
    return u.join(a, ["conv_id", "turn"])
