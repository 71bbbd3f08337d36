"""Benchmark decontamination by greedy string tiling.

1. Seeds: every run of ``TILE`` tokens of a benchmark item is hashed (Karp-Rabin over token hashes). Tiles that reach the
   coverage hold at least ``needed`` of an item's seeds. A counting filter of a fixed size, the only thing broadcast,
   tells each document task which runs may be shared and how many their items need; documents without enough for any
   item leave the plan there.
2. Candidates: the surviving runs are joined with the items' runs; (document, item) pairs that share as many seeds as
   the item needs are kept. No pair that tiling would accept is lost.
3. Tiling: for each pair, the longest match of tokens that no earlier match has used is marked, again and again, down
   to ``TILE`` tokens. The part of the item's tokens under tiles is its coverage, whatever the order of the passages.

A document is contaminated by an item if coverage reaches ``COVERAGE``. Tokens are runs of Unicode letters and digits,
with their combining marks, of the lower-cased text in form NFKC; in scripts without spaces each letter is a token. So
punctuation and spacing of any kind, soft hyphens and full-width forms don't hide a passage.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Callable, Iterator
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusforge.llm.common import map_rows, packed, unpacked, written

TILE, COVERAGE = 3, 0.8
#: The filter has 2**BITS bytes, two for each seed: the least number of seeds that an item with it needs, 0 for no item.
BITS = 24
MOST = 255
#: Letters of Thai, Lao, Myanmar, Khmer, Tai, Javanese, Japanese and Chinese.
UNSPACED = ("\u0E00-\u0E4F\u0E80-\u0ECF\u0EDC-\u0EDF\u1000-\u103F\u1050-\u108F\u1780-\u17D3\u1950-\u19CF\u1A20-\u1A7F\uA980-\uA9C0\uA9E0-\uA9EF"
            "\uA9FA-\uA9FE\uAA60-\uAADF\u3005-\u3007\u3021-\u3029\u3031-\u303C\u3041-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF"
            "\U0001B000-\U0001B16F\U00020000-\U0003FFFF")
#: Combining marks but variation selectors.
MARKS = "".join(c for c in map(chr, range(0x300, 0x1F000)) if unicodedata.category(c)[0] == "M" and not "\uFE00" <= c <= "\uFE0F")
ASCII_TOKEN, PLAIN_TOKEN = re.compile(rb"[0-9a-z]+"), re.compile(r"[^\W_]+")
SPECIAL = re.compile(f"[{UNSPACED}{MARKS}]")
TOKEN = re.compile(f"(?![_{UNSPACED}])\\w(?:(?![_{UNSPACED}])[\\w{MARKS}])*|(?!_)[{UNSPACED}](?<=\\w)[{MARKS}]*")
#: Characters that are not seen: soft hyphen, joiners, byte order mark.
UNSEEN = re.compile("[\u00AD\u200C\u200D\u2060\uFEFF]")
BASE, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    text = (text or "").lower()
    if text.isascii():
        return ASCII_TOKEN.findall(text.encode())
    plain = unicodedata.normalize("NFKC", UNSEEN.sub("", text)).lower()
    words = TOKEN.findall(plain) if SPECIAL.search("".join(set(plain))) else PLAIN_TOKEN.findall(plain)
    return [w.encode("utf-8", "replace") for w in words]


def rolling(words: list[bytes], length: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``length`` tokens, mixed."""
    codes = np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(1)
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(length):
        total = total * BASE + codes[j:j + n]
    total = (total ^ (total >> np.uint64(29))) * MIX
    return total ^ (total >> np.uint64(32))


def seeds(words: list[bytes], lengths: list[int]) -> np.ndarray:
    """Distinct seed hashes of the runs of the given lengths, as signed longs."""
    parts = [rolling(words, n) for n in lengths]
    return np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64)


def needed(words: list[bytes], tile: int, coverage: float) -> int:
    """Least number of distinct seeds that a document shares with an item which it covers: tiles of c tokens in all begin
    c / tile seeds of the item at least, and the most repeated seeds may be those."""
    n = len(words)
    length = min(tile, n)
    if not n:
        return 1
    least = next((c for c in range(max(1, int(coverage * n) - 1), n) if c / n >= coverage), n)
    _, times = np.unique(rolling(words, length), return_counts=True)
    return int(np.searchsorted(np.cumsum(np.sort(times)[::-1]), -(-least // length))) + 1


def enough(needs: np.ndarray) -> bool:
    """Whether, for some k, at least k seeds belong to items that need k or fewer."""
    return bool((np.sort(needs) <= np.arange(1, len(needs) + 1)).any())


def probes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the filter for each seed."""
    h = hashes.view(np.uint64)
    return (h >> np.uint64(64 - BITS)).astype(np.int64), (h & np.uint64((1 << BITS) - 1)).astype(np.int64)


def matches(item: list[bytes], doc: list[bytes], least: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of at least ``least`` tokens as (length, start in item, start in doc)."""
    table: dict[int, list[int]] = {}
    for i, h in enumerate(rolling(item, least).tolist()):
        table.setdefault(h, []).append(i)
    running = rolling(doc, least)
    shared = np.flatnonzero(np.isin(running, np.fromiter(table, np.uint64, len(table))))
    diagonals: dict[int, list[int]] = {}
    for j in shared.tolist():
        gram = doc[j:j + least]
        for i in table[int(running[j])]:
            if item[i:i + least] == gram:
                diagonals.setdefault(j - i, []).append(i)
    found = []
    for shift, starts in diagonals.items():
        begin = last = starts[0]
        for i in [*starts[1:], None]:
            if i != last + 1:
                found.append((last - begin + least, begin, begin + shift))
                begin = i
            last = i
    return found


def tiling(item: list[bytes], doc: list[bytes], least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (length, start in item, start in doc) of the tiles, longest first; ties go to the
    earlier place in the item, then in the document. A match that a tile cuts goes back as the runs left of it."""
    least = min(least, len(item))
    if not least or len(doc) < least:
        return []
    used_item, used_doc = bytearray(len(item)), bytearray(len(doc))
    heap = [(-n, i, j) for n, i, j in matches(item, doc, least)]
    heapq.heapify(heap)
    tiles, free = [], len(item)
    while heap and free >= least:
        n, i, j = heapq.heappop(heap)
        n = -n
        if not any(used_item[i:i + n]) and not any(used_doc[j:j + n]):
            used_item[i:i + n] = used_doc[j:j + n] = b"\1" * n
            tiles.append((n, i, j))
            free -= n
            continue
        begin = None
        for k in range(n + 1):
            if k < n and not used_item[i + k] and not used_doc[j + k]:
                begin = k if begin is None else begin
            elif begin is not None:
                if k - begin >= least:
                    heapq.heappush(heap, (begin - k, i + begin, j + begin))
                begin = None
    return tiles


def _shared_seeds(docs: DataFrame, text: str, filter_: bytes, lengths: list[int], keep: bool) -> DataFrame:
    """Rows of ``docs`` with seeds that pass the filter, enough for some item, and those seeds as ``_seeds``; or, not
    ``keep``, the others."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.frombuffer(decompress(shared.value), np.uint8)
        for batch in batches:
            found = []
            for value in batch.column(at):
                own = seeds(tokens(value.as_py()), lengths)
                a, b = probes(own)
                needs = np.where(least[a] == 0, 0, np.maximum(least[a], least[b]) * (least[b] > 0))
                found.append(own[needs > 0] if enough(needs[needs > 0]) else own[:0])
            rows = pa.array(np.flatnonzero([(len(x) > 0) == keep for x in found]), pa.int64())
            part = batch.take(rows)
            if keep:
                part = pa.RecordBatch.from_arrays([*part.columns, pa.array([found[i] for i in rows.to_pylist()], pa.list_(pa.int64()))],
                                                  [*part.schema.names, "_seeds"])
            yield part

    extra = [T.StructField("_seeds", T.ArrayType(T.LongType()))] if keep else []
    return map_rows(docs, run, *extra)


def _items(benchmark: DataFrame, tile: int, coverage: float) -> DataFrame:
    """(item_id, item, n, _needed, _seeds): distinct items with a token, their number of tokens, the number of seeds that
    a document needs, and the seeds; an item of fewer tokens than a seed is a seed as a whole."""
    slim = benchmark.select("item_id", F.col("text").cast("string").alias("item")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [tokens(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array([len(w) for w in words], pa.int64()),
                pa.array([needed(w, tile, coverage) for w in words], pa.int64()),
                pa.array([seeds(w, [min(tile, len(w))]) if w else [] for w in words], pa.list_(pa.int64()))],
                ["item_id", "item", "n", "_needed", "_seeds"])

    return slim.mapInArrow(run, T.StructType([*slim.schema.fields, T.StructField("n", T.LongType()), T.StructField("_needed", T.LongType()),
                                              T.StructField("_seeds", T.ArrayType(T.LongType()))])).where("n > 0")


def search(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """(doc_id, _hash, item_id, coverage, n_tiles, longest) of the contaminated pairs, and a function that gives the
    documents without them.

    ``_hash`` is the xxhash64 of the text; rows of equal id and text are one document here. Null and empty texts, of
    documents or items, hold nothing and match nothing; null ids are ids like others; repeated items count once for
    each item_id; empty tables give no pairs, and all documents. Documents with enough shared seeds are kept in the
    checkpoint folder with their seeds; others are never shuffled.
    """
    items = written(_items(benchmark, tile, coverage))
    lengths = sorted(r["length"] for r in items.select(F.least(F.lit(tile), F.col("n")).alias("length")).distinct().collect())
    mask = np.uint64((1 << BITS) - 1).item()
    places = (items.select(F.least("_needed", F.lit(MOST)).alias("least"), F.explode("_seeds").alias("s"))
              .select("least", F.explode(F.array(F.shiftrightunsigned("s", 64 - BITS), F.col("s").bitwiseAND(F.lit(mask)))).alias("place"))
              .groupBy("place").agg(F.min("least").alias("least")).toArrow())  # at most 2**BITS rows
    least = np.zeros(1 << BITS, np.uint8)
    least[places["place"].to_numpy().astype(np.int64)] = places["least"].to_numpy()
    filter_ = compress(least.tobytes(), 1)
    read = ("doc_id", "text")
    named = packed(docs, read).withColumn("text", F.col("text").cast("string")).withColumn("_hash", F.xxhash64("text"))
    near = written(_shared_seeds(named, "text", filter_, lengths, keep=True))
    named_items = items.withColumn("_item", F.xxhash64("item_id", "item"))
    pairs = (near.groupBy("doc_id", "_hash").agg(F.first("_seeds").alias("_seeds"))
             .select("doc_id", "_hash", F.explode("_seeds").alias("_seed"))
             .join(named_items.select("_item", "_needed", F.explode("_seeds").alias("_seed")), "_seed")
             .groupBy("doc_id", "_hash", "_item", "_needed").agg(F.count("*").alias("_shared")).where("_shared >= _needed")
             .join(named_items.select("_item", "item_id", "item"), "_item").select("doc_id", "_hash", "item_id", "item"))
    asked = pairs.groupBy("doc_id", "_hash").agg(F.collect_list(F.struct("item_id", "item")).alias("_items"))
    texts = near.select("doc_id", "_hash", "text").dropDuplicates(["doc_id", "_hash"])
    tested = texts.alias("t").join(asked.alias("a"), F.col("t.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("t._hash") == F.col("a._hash")))
    tested = tested.select("t.doc_id", "t._hash", "t.text", "a._items")

    item_field = items.schema["item_id"]
    item_type = to_arrow_type(item_field.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, (text, asked_) in enumerate(zip(batch.column(2), batch.column(3))):
                words = tokens(text.as_py())
                for one in asked_.as_py():
                    item = tokens(one["item"])
                    tiles = tiling(item, words, tile)
                    share = sum(t[0] for t in tiles) / len(item)
                    if share >= coverage:
                        at.append(k)
                        rows.append((one["item_id"], share, len(tiles), tiles[0][0]))
            picked = batch.take(pa.array(at, pa.int64()))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(1), pa.array(cols[0], item_type), pa.array(cols[1], pa.float64()),
                                              pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                                             ["doc_id", "_hash", "item_id", "coverage", "n_tiles", "longest"])

    found = tested.mapInArrow(run, T.StructType([
        tested.schema["doc_id"], tested.schema["_hash"], item_field, T.StructField("coverage", T.DoubleType()),
        T.StructField("n_tiles", T.LongType()), T.StructField("longest", T.LongType())]))

    def clean() -> DataFrame:
        """Rows of ``docs`` that no item contaminates: those without enough shared seeds, as they stream by, and those of
        the kept candidates that aren't among the pairs."""
        hit = found.select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_found")).distinct()
        far = _shared_seeds(named, "text", filter_, lengths, keep=False)
        spared = near.join(hit, near["doc_id"].eqNullSafe(hit["_id"]) & (near["_hash"] == hit["_found"]), "left_anti")
        columns = unpacked(docs, read)
        return far.select(columns).unionByName(spared.select(columns))

    return found, clean
