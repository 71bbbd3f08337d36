"""A training-data pipeline: toxic documents go, one of each near-duplicate group stays, documents that hold a
benchmark item go, sources are mixed to target weights, and the mix is dealt into shards.

Every stage reads what its predecessor wrote and, but for the last, returns the columns of its input. Columns that an
operator doesn't read travel in one struct, so that their names never meet an operator's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import decontaminate, mixing, sharding, simhash, toxicity
from corpusforge.llm.common import packed, table, unpacked
from corpusforge.llm.queries import SHARDS, WEIGHTS

READ = ("doc_id", "text", "source")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones among them, doesn't call toxic."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), F.col("doc_id").isNotNull())
    return toxicity.score(packed(docs, READ), model).where(F.col("score") < 0.5).select(unpacked(docs, READ))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs, shingle=3, distance=2)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _, clean = decontaminate.search(docs, table(spark, sf_dir, "benchmark"))
    return clean()


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them (up to three times)."""
    found = mixing.mix(packed(docs, READ), WEIGHTS, carry=["text", "row"])
    return found.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(unpacked(docs, READ))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, of 16 equal ones, and their slot in it."""
    found = sharding.assign(packed(docs, READ), [1.0] * SHARDS, "doc_id", ["text", "source", "row"], ["text"])
    return found.select(*unpacked(docs, READ, but=("shard", "slot")), "shard", "slot")


STAGES = [("toxicity", toxic), ("near_duplicates", near_copies), ("decontamination", benchmark_passages),
          ("mixing", mixed), ("sharding", shards)]
#: The toxicity model and the fingerprints have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
