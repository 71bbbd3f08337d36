"""Corpus registry: named corpora with role, location and direction, read
into one keyed line table."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY_SCHEMA = "name string, role string, path string, src string, tgt string"


def corpora(spark: SparkSession, entries: Iterable[tuple[str, str, str, str, str]]) -> DataFrame:
    """A small registry DataFrame ``(name, role, path, src, tgt)``."""
    return spark.createDataFrame(list(entries), REGISTRY_SCHEMA)


def read_registered(spark: SparkSession, registry: DataFrame, reader: Callable[[SparkSession, str], DataFrame],
                    role: str | None = None) -> DataFrame:
    """Read every registered corpus (optionally one role) with ``reader`` and
    union them with ``corpus``/``role`` literals. The registry itself is a
    handful of rows, so it is listed on the driver to build the plan."""
    rows = registry.where(F.col("role") == role).collect() if role else registry.collect()
    frames = [reader(spark, r["path"]).withColumn("corpus", F.lit(r["name"])).withColumn("role", F.lit(r["role"]))
              for r in rows]
    if not frames:
        raise ValueError("no corpus registered for this role")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def join_registered(lines: DataFrame, registry: DataFrame, key, role: str | None = None) -> DataFrame:
    """Corpora stored in one table: tag each row with its registered corpus by
    a join with the registry (one row per corpus; Spark broadcasts it if it
    is small) on ``key`` (matched against the registry's ``path``) — one scan instead of one read per
    corpus; rows of unregistered corpora are dropped."""
    reg = registry.where(F.col("role") == role) if role else registry
    k = F.col(key) if isinstance(key, str) else key
    tagged = lines.withColumn("_reg_key", k)
    reg = reg.select(F.col("path").alias("_reg_key"), F.col("name").alias("corpus"), "role")
    return tagged.join(reg, "_reg_key").drop("_reg_key")


def check_joint(src_kind: str, tgt_kind: str, src_size: int | None, tgt_size: int | None) -> None:
    """A joint vocabulary needs the same segmentation and size on both sides."""
    if src_kind != tgt_kind:
        raise ValueError(f"joint vocabulary needs one segmentation, got {src_kind!r} and {tgt_kind!r}")
    if src_kind != "char" and src_size != tgt_size:
        raise ValueError(f"joint vocabulary needs one size, got {src_size} and {tgt_size}")
