"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: sources share the budget by weight, none above ``cap`` times its size; what a capped source cannot
   take is reshared by weight (water-filling, in closed form over the sources).
2. Quotas: the budget is a row of equal blocks of tokens, cut into shards. Blocks go to the highest quotients
   ``target / (2 k - 1)``. The method is house-monotone, so a shard's integer quota of a source is its seats
   among the blocks up to the shard's end less those up to its start.
3. Blocks: a source's documents lie one after another in a seeded order of size class and hash; block b holds
   tokens ``[b B, (b + 1) B)``. Blocks are dealt to the shards in turn, from a seeded shard on, and every shard
   chooses its quota among its own: with q due of m, each is taken ``q div m`` times and ``r = q mod m`` of them once
   more, those at which ``(j r + seeded offset) div m`` steps up for the shard's j-th block, exactly r, evenly
   spread. A document's share of a shard's choice follows from its first and last token by arithmetic; no block is
   listed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import WORD, hex_key, hex_number

SEED = "mix"
BLOCK = 64
SHARDS = 16
#: Hex digits of the hash that split a size class of a source.
SPLIT_DIGITS = 2


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    """Sorts by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def size_class(size: Column) -> Column:
    """Classes of sizes within about 9 %: eight for each doubling."""
    return F.floor(F.log2(size.cast("double") + F.lit(1.0)) * F.lit(8.0)).cast("int")


def targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """(key, source_size, weight, target) from (key, source_size), one row a source.

    ``weights`` repeat along the keys in order. The windows run over one row a source, not over documents.
    """
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy("key")) - 1
    weighted = sizes.select("key", "source_size", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
                            .cast("long").alias("weight"))
    limit = F.col("source_size") * cap
    fill = Window.orderBy((limit / F.col("weight")).asc(), F.col("key").asc()).rowsBetween(Window.unboundedPreceding, -1)
    total, heavy = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    left = total - F.coalesce(F.sum(limit).over(fill), F.lit(0))
    open_weight = heavy - F.coalesce(F.sum("weight").over(fill), F.lit(0))
    level = weighted.withColumn("limit", limit).withColumn("level", left.cast("double") / open_weight.cast("double"))
    settled = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "key", "level"))).over(everything)
    return level.withColumn("settled", settled["level"]).select(
        "key", "source_size", "weight", F.least(F.col("limit").cast("double"), F.col("weight") * F.col("settled")).alias("target"))


def quotas(aims: DataFrame, block: int = BLOCK, shards: int = SHARDS, cap: int = 3) -> DataFrame:
    """(key, shard, quota) from (key, source_size, target): integer blocks of each source in each shard.

    With N blocks in all and S sources, the winning divisor lies between T / (N + S/2) and T / (N - S/2); a source
    surely holds the seats it has at the one end and surely not those beyond the other, so only about 2 S seats
    have to be ranked for each shard. A source never gets more than ``cap`` times its own blocks.
    """
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("target").over(everything)
    sized = aims.select("key", "source_size", "target", total.alias("total"), F.count("*").over(everything).alias("sources"))
    ends = sized.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    blocks = F.floor((F.col("total") * 2 + block) / (2 * block))
    ends = ends.withColumn("house", F.floor(blocks * F.col("shard") / shards).cast("long"))
    share = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(F.lit(0.0))
    own = F.ceil(F.col("source_size") / block) * cap
    low = F.greatest(F.lit(0), F.least(F.floor(share * (F.col("house") - F.col("sources") / 2) + 0.5) - 1, own)).cast("long")
    high = F.least(F.ceil(share * (F.col("house") + F.col("sources") / 2) + 0.5) + 1, own).cast("long")
    bounds = ends.withColumn("low", low).withColumn("high", F.greatest(high, F.col("low")))
    free = F.col("house") - F.sum("low").over(Window.partitionBy("shard"))
    seats = bounds.withColumn("free", free).withColumn(
        "seat", F.explode_outer(F.when(F.col("high") > F.col("low"), F.sequence(F.col("low") + 1, F.col("high")))))
    best = Window.partitionBy("shard").orderBy(F.col("quotient").desc_nulls_last(), F.col("key"))
    ranked = seats.withColumn("quotient", F.col("target") / (F.col("seat") * 2 - 1)).withColumn("nth", F.row_number().over(best))
    upto = (ranked.groupBy("key", "shard").agg(
        F.first("low").alias("low"), F.count_if(F.col("seat").isNotNull() & (F.col("nth") <= F.col("free"))).alias("won"))
        .select("key", "shard", (F.col("low") + F.col("won")).alias("seats")))
    before = F.lag("seats", 1, 0).over(Window.partitionBy("key").orderBy("shard"))
    return upto.select("key", (F.col("shard") - 1).alias("shard"), (F.col("seats") - before).alias("quota"))


def choices(aims: DataFrame, block: int = BLOCK, shards: int = SHARDS, cap: int = 3, seed: str = SEED) -> DataFrame:
    """(key, quota, picks) from (key, source_size, target): the source's blocks in the mix, and for each shard, in
    order, the struct (turn, own, full, rest, offset) that says which blocks it takes. Block b goes to the shard whose
    turn is ``b mod shards``; ``own`` blocks fall to it, all taken ``full`` times and ``rest`` of them once more.

    A shard that is due more than ``cap`` times its own blocks leaves the excess to the next ones with room, then to
    the first ones; a source is never due more than all its shards can take.
    """
    first = hex_number(hex_key(seed + ":turn", F.col("key")), 8)
    due = quotas(aims, block, shards, cap).join(aims.select("key", F.ceil(F.col("source_size") / block).cast("long").alias("blocks")), "key")
    due = due.withColumn("turn", F.pmod(F.col("shard") - first, F.lit(shards)).cast("long"))
    due = due.withColumn("own", F.expr(f"(blocks - turn + {shards - 1}) div {shards}"))
    whole = Window.partitionBy("key")
    upto = whole.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    before = whole.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    room = F.sum("own").over(upto) * cap
    served = (due.withColumn("room", room).withColumn("lead", F.sum("quota").over(upto) - F.col("room"))
              .withColumn("upto", F.col("room") + F.least(F.lit(0), F.min("lead").over(upto)))
              .withColumn("got", F.col("upto") - F.lag("upto", 1, 0).over(whole.orderBy("shard")))
              .withColumn("free", F.col("own") * cap - F.col("got"))
              .withColumn("left", F.sum("quota").over(whole) - F.max("upto").over(whole) - F.coalesce(F.sum("free").over(before), F.lit(0)))
              .withColumn("got", F.col("got") + F.least(F.col("free"), F.greatest(F.lit(0), F.col("left")))))
    some = F.greatest(F.col("own"), F.lit(1))
    offset = hex_number(hex_key(seed + ":blocks", F.col("key"), F.col("shard")), 8) % some
    pick = F.struct(F.col("shard"), F.col("turn"), some.alias("own"), F.call_function("div", F.col("got"), some).alias("full"),
                    (F.col("got") % some).alias("rest"), offset.alias("offset"))
    return served.groupBy("key").agg(F.sum("got").alias("quota"), F.sort_array(F.collect_list(pick)).alias("picks"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, block: int = BLOCK, shards: int = SHARDS,
        carry: Sequence[str] = (), seed: str = SEED) -> DataFrame:
    """(doc_id, source, *carry, size, source_size, target, quota, taken, by_shard, copies) of every row of ``docs``.

    ``by_shard``: words of the row in the blocks that each shard takes, a block taken twice counting twice; ``taken``:
    their sum, at most ``cap`` times ``size``. ``copies``: how often a mix of whole documents repeats the row: the whole passes over its source, and
    one more for an evenly spread part of its documents, in the same seeded order.

    Null texts and texts without words have size 0 and are never taken; null sources form one source, the last;
    equal rows are laid out side by side and interchangeable; rows with a null doc_id are ordered by size and
    hash like others; an empty table gives no rows. Documents are shuffled once, by (source, size class, hash
    range), so a source with a third of all rows is spread; range totals come from a scan of its own.
    """
    out = ("size", "source_size", "target", "quota", "taken", "by_shard", "copies")
    kept = [c for c in dict.fromkeys(["doc_id", "source", *carry]) if c not in out]
    laid = docs.select(*kept, n_words(F.col("text")).alias("size"), source_key(F.col("source")).alias("_key"),
                       hex_key(seed, F.col("doc_id")).alias("_order"))
    laid = laid.withColumn("_class", size_class(F.col("size"))).withColumn("_range", hex_number(F.col("_order"), SPLIT_DIGITS).cast("int"))
    place = ["_key", "_class", "_range"]
    totals = laid.groupBy(*place).agg(F.sum("size").alias("_words"), F.count("*").alias("_rows"))
    sizes = totals.groupBy("_key").agg(F.sum("_words").alias("source_size")).withColumnRenamed("_key", "key")
    aims = targets(sizes, weights, cap)
    due = choices(aims, block, shards, cap, seed)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block)).cast("long")
    plan = (aims.join(due, "key").withColumn("_blocks", blocks)
            .withColumn("_full", F.expr("quota div _blocks")).withColumn("_rest", F.col("quota") % F.col("_blocks"))
            .withColumn("_offset", hex_number(hex_key(seed + ":blocks", F.col("key")), 8) % F.col("_blocks"))
            .withColumnRenamed("key", "_key"))
    before = Window.partitionBy("_key").orderBy("_class", "_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*place, F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_word0"),
                           F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0")).join(plan, "_key")
    within = Window.partitionBy(*place).orderBy("_order", "size", "doc_id", *(c for c in carry if c in kept))
    runs = (laid.withColumn("_end", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_row", F.row_number().over(within)).join(starts, place)
            .withColumn("_end", F.col("_end") + F.col("_word0")).withColumn("_begin", F.col("_end") - F.col("size")))

    def whole(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    def by_shard(p: Column) -> Column:
        def words_before(at: Column) -> Column:
            """Words of the blocks that the shard takes, up to a place in the source."""
            b = whole(at, F.lit(block))
            n = whole(b - p["turn"] + (shards - 1), F.lit(shards))

            def times(k: Column) -> Column:
                return p["full"] * k + whole(k.cast("decimal(19,0)") * p["rest"] + p["offset"], p["own"])

            part = F.when(b % shards == p["turn"], (times(n + 1) - times(n)) * (at % block)).otherwise(0)
            return times(n) * block + part

        return words_before(F.col("_end")) - words_before(F.col("_begin"))

    part = (F.col("_rest") * block).cast("double") / F.greatest(F.col("source_size"), F.lit(1))
    nth = F.col("_row0") + F.col("_row")
    jitter = F.col("_offset").cast("double") / F.col("_blocks")
    extra = F.floor(nth * part + jitter) - F.floor((nth - 1) * part + jitter)
    copies = F.when(F.col("size") > 0, F.least(F.lit(cap), F.col("_full") + extra)).otherwise(F.lit(0)).cast("int")
    shared = runs.withColumn("by_shard", F.transform("picks", by_shard))
    taken = F.aggregate("by_shard", F.lit(0).cast("long"), lambda a, x: a + x)
    return shared.select(*kept, "size", "source_size", "target", "quota", taken.alias("taken"), "by_shard", copies.alias("copies"))
