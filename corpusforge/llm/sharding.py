"""Sharding by rendezvous hashing of a stable key over weighted shards.

Every (key, shard) pair draws a number in (0, 1) from the md5 of seed, shard and key; the shard with the
smallest ``-ln(draw) / weight`` takes the row. A draw depends on nothing else, so adding a shard moves only
the rows that the new shard wins, and shard sizes follow the weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import hex_key, hex_number, let

SEED = "shard"
#: Hex digits of the slot key that name a slot range; 16**3 ranges a shard are numbered apart.
RANGE_DIGITS = 3


def costs(key: Column, weights: Sequence[float], seed: str = SEED) -> Column:
    """Array of (cost, shard) by shard; the cost is ``-ln(u) / weight`` of the draw u of (key, shard)."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    weight = F.array(*(F.lit(float(w)) for w in weights))

    def one(shard: Column) -> Column:
        draw = (hex_number(hex_key(seed, shard, key), 13).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
        return F.struct((-F.log(draw) / F.get(weight, shard)).alias("cost"), shard.alias("shard"))

    return F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), one)


def rendezvous(key: Column, weights: Sequence[float], seed: str = SEED) -> Column:
    """Number of the shard that takes ``key``; the smaller number wins a tie. A null key is a key like any other."""
    return F.array_min(costs(key, weights, seed))["shard"]


def assign(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", carry: Sequence[str] = (),
           tie: Sequence[str] = (), grown_weight: float | None = None, seed: str = SEED) -> DataFrame:
    """(key, *carry, shard, slot[, grown_shard]) for every row of ``docs``.

    ``slot`` numbers the rows of a shard from 0 without gaps, in the order of a seeded hash of the key, then the
    key, then the columns ``tie``; equal rows are interchangeable. A shard is never sorted as one group: its rows
    are dealt into 16**RANGE_DIGITS ranges of the hash, each numbered by itself and shifted by the rows before it.
    Range totals (at most shards * ranges rows) come from a scan of the key alone and meet the rows in the
    partitioning that numbers them.

    Nulls in the key share one shard and are spread over the ranges by ``tie``; empty tables give no rows;
    a column named like a result column is replaced, other extra columns are carried only if named.
    """
    weights = list(weights)
    k = F.col(key)
    spread = hex_key(seed + ":slot", k, *(F.when(k.isNull(), F.col(c)) for c in tie))
    keep = [c for c in dict.fromkeys([key, *carry, *tie]) if c not in ("shard", "slot", "grown_shard")]
    n = len(weights)
    if grown_weight is None:
        shards = [rendezvous(k, weights, seed).alias("shard")]
    else:
        both = let(costs(k, [*weights, grown_weight], seed), lambda c: F.struct(
            F.array_min(F.slice(c, 1, n))["shard"].alias("shard"), F.array_min(c)["shard"].alias("grown_shard")))
        shards = [both["shard"].alias("shard"), both["grown_shard"].alias("grown_shard")]
    placed = docs.select(*keep, *shards, spread.alias("_order"))
    placed = placed.withColumn("_range", hex_number(F.col("_order"), RANGE_DIGITS).cast("int"))
    totals = placed.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_range").orderBy("_order", key, *tie)
    numbered = placed.withColumn("_row", F.row_number().over(within)).join(starts, ["shard", "_range"])
    out = [*dict.fromkeys([key, *(c for c in carry if c in keep)]), "shard", (F.col("_start") + F.col("_row") - 1).alias("slot")]
    return numbered.select(*out, *(["grown_shard"] if grown_weight is not None else []))
