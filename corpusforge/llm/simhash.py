"""SimHash near-duplicates: fingerprints, pigeonhole block join, Hamming check, connected groups.

A fingerprint has a bit set where more than half of the text's shingle hashes have it. Two fingerprints link at
``distance`` or fewer differing bits. Cut into ``blocks`` blocks, such a pair agrees on all but ``distance`` of
them, so each fingerprint is filed under every choice of ``blocks - distance`` blocks and pairs are sought only
among fingerprints filed alike. A file of more than ``full`` fingerprints would give a square of pairs; its
members are linked instead through the fingerprints around them: x and y differ in at most two bits exactly if
some value is at most one bit from both, so each member names itself and its 64 one-bit neighbours, and members
that name the same value are linked to the smallest of them. That is exact and grows with the members.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.llm.common import packed, unpacked, written
from corpusforge.llm.components import connected

CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; A-Z count as a-z. Fewer words than a shingle
    form one shingle, no words (or null) give 0. Bytes of the whole text are read."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    set_in = np.zeros(64, np.int64)
    first, last = starts[:n].tolist(), ends[shingle - 1:].tolist()
    for at in range(0, n, CHUNK):
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(first[at:at + CHUNK], last[at:at + CHUNK])),
                             np.uint64, min(CHUNK, n - at))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += bits.sum(axis=0, dtype=np.uint32)
    return int(sum(1 << i for i in np.flatnonzero(2 * set_in > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """``docs`` with the column ``text`` replaced by its fingerprint ``fp``, a signed long; the text is read in
    place, never shuffled."""
    slim = docs.select(*(c for c in docs.columns if c not in (text, "fp")), F.col(text).cast("string").alias(text))
    kept = slim.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.columns[-1]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp, pa.int64())],
                                             [*batch.schema.names[:-1], "fp"])

    return slim.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("fp", T.LongType())]))


def block_masks(blocks: int, distance: int) -> list[int]:
    """Bit masks (signed) of every choice of ``blocks - distance`` of the blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(block[i] for i in kept) for kept in combinations(range(blocks), blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(values: DataFrame, distance: int = 2, blocks: int = 4, full: int = 64) -> DataFrame:
    """(a, b), a > b: links between the distinct fingerprints in ``values.fp`` whose connected groups are those of
    all pairs within ``distance`` bits (1 or 2; a file over ``full`` needs at most 2)."""
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    masks = block_masks(blocks, distance)
    filed = values.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks)))
                          .alias("mask", "block"))
    sizes = filed.groupBy("mask", "block").agg(F.count("*").alias("n")).where("n > 1")
    shared = filed.join(sizes, ["mask", "block"])
    cold = shared.where(F.col("n") <= full)
    a, b = cold.alias("a"), cold.alias("b")
    pairs = (a.join(b, (F.col("a.mask") == F.col("b.mask")) & (F.col("a.block") == F.col("b.block"))
                    & (F.col("a.fp") > F.col("b.fp"))
                    & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance))
             .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))
    crowded = shared.where(F.col("n") > full).select("fp").distinct()
    reach = [0, *(1 << i if i < 63 else -(1 << 63) for i in range(64))] if distance == 2 else [0]
    around = crowded.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(x)) for x in reach))).alias("near"))
    if distance == 1:  # a value and its neighbours name the value itself
        flips = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
        around = crowded.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(x)) for x in flips))).alias("b"))
        stars = around.join(crowded.select(F.col("fp").alias("b")), "b").where("fp > b").select(F.col("fp").alias("a"), "b")
    else:
        low = F.min("fp").over(Window.partitionBy("near"))
        stars = around.select(F.col("fp").alias("a"), low.alias("b")).where("a > b")
    return pairs.unionByName(stars).distinct()


def groups(prints: DataFrame, distance: int = 2, blocks: int = 4, full: int = 64, key: str = "doc_id") -> DataFrame:
    """(fp, group_fp, component_id): each distinct fingerprint with the smallest fingerprint and the smallest
    non-null key of its connected group (null if the group has none)."""
    values = prints.groupBy("fp").agg(F.min(key).alias("low"))
    stars = connected(links(values.select("fp"), distance, blocks, full))
    rooted = values.join(stars.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("group_fp"))
    lowest = rooted.groupBy("group_fp").agg(F.min("low").alias("component_id"))
    return rooted.select("fp", "group_fp").join(lowest, "group_fp").select("fp", "group_fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, blocks: int = 4, full: int = 64,
                    key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(key, *carry, fp, group_fp, component_id) of every row.

    Null and empty texts have fingerprint 0 and link like any other; equal rows stay separate rows; rows with a
    null key belong to a group but never name it; an empty table gives no rows; other columns are ignored.
    The texts are read once: fingerprints and keys are kept in the checkpoint folder.
    """
    prints = written(fingerprints(docs.select(*dict.fromkeys([key, *carry, text])), shingle, text))
    return prints.join(groups(prints, distance, blocks, full, key), "fp").select(
        *dict.fromkeys([key, *carry]), "fp", "group_fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 2, blocks: int = 4, full: int = 64) -> DataFrame:
    """The documents with one row for each near-duplicate group: that with the group's smallest doc_id (a null
    doc_id comes last), then the smallest hash of the text, then the smallest other columns.

    Groups are found on keys and hashes; the documents meet the chosen (doc_id, hash) pairs in one join, and the
    row numbers that settle fully repeated keys reuse its partitioning.
    """
    read = ("doc_id", "text")
    named = packed(docs, read).withColumn("_hash", F.xxhash64("text"))
    found = near_duplicates(named.select("doc_id", "_hash", "text"), shingle, distance, blocks, full, carry=["_hash"])
    chosen = found.groupBy("group_fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_hash"))
                                           .alias("first")).select(F.col("first.doc_id").alias("_id"),
                                                                   F.col("first._hash").alias("_first"))
    same = Window.partitionBy("_id", "_first").orderBy("text", "row")
    return (named.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_first")))
            .withColumn("_nth", F.row_number().over(same)).where("_nth = 1").select(unpacked(docs, read)))
