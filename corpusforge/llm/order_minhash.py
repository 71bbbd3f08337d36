"""Document fingerprints by Order MinHash, in DataFrame expressions.

A text's items are its k-mers of ``K`` units, each numbered by how often the same k-mer came before it. A unit is a
word of at most ``LONG`` characters; longer words, and runs of scripts that are written without spaces, count
character by character, so that one changed character changes ``K`` items there too. Every item has one place on a ring of hashes. Sketch i starts at i / SKETCHES of the ring and selects the ``TUPLE`` items that
follow - the minimal ones in the order that starts there - puts them back into the order of the text, and hashes
that tuple. Two texts agree in a sketch if they share its items in the same order, so the share of equal sketches
falls with the edit distance, also where the same words are rearranged.

Everything about one text happens in its own row: arrays of longs are sorted, cut and compared by built-in
functions, and no k-mer is ever shuffled. A k-mer is held as 36 bits of hash beside 28 bits of position, which
bounds a text to 2**27 units; Spark's own bound on a row, 2 GiB with its arrays of 8 bytes an item, is met before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.llm.common import let

K, TUPLE, SKETCHES = 2, 2, 64
PLACE_BITS = 28
PLACE = (1 << PLACE_BITS) - 1
#: Characters of a word that still counts as one unit.
LONG = 24
#: Quantiles of the key that bound the coarse ranges of the ordered pass, rows for each of its tasks and ranges dealt to
#: each, ranges whose first rows are broadcast, and parts of a repeated key (by the first two bytes of the text).
QUANTILES, TASK_ROWS, TASK_RANGES, KNOWN, PARTS = 256, 8192, 8, 1 << 19, 1 << 16
# Scripts written without spaces (Thai, Lao, Tibetan, Myanmar, Khmer, Chinese, Japanese).
UNSPACED = r"\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{3FFFF}"
SPACE = r" \t\n\x0B\f\r"
INSIDE = f"[^{SPACE}{UNSPACED}]"
UNIT = f"(?<!{INSIDE}){INSIDE}{{1,{LONG}}}+(?!{INSIDE})|[^{SPACE}]"


def _units(text: Column) -> Column:
    """Units of the whole text; none for a null or blank text."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(UNIT), F.lit(0))


def _kmers(hashes: Column) -> Column:
    """Hashes of the runs of ``K`` unit hashes; the whole sequence if it is shorter, none if it is empty."""
    def runs(h: Column) -> Column:
        n = F.size(h) - (K - 1)
        out = F.slice(h, 1, n)
        for j in range(1, K):
            out = F.zip_with(out, F.slice(h, j + 1, n), lambda a, b: F.xxhash64(a, b))
        return F.when(F.size(h) >= K, out).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.slice(h, 1, 0))

    return let(hashes, runs)


def _numbered(kmers: Column) -> Column:
    """Item hashes with places: sorted by k-mer and place, the j-th of equal k-mers gets number j."""
    packed = F.transform(kmers, lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long")))

    def item(x: Column, nth: Column) -> Column:
        h = F.xxhash64(F.shiftright(x, PLACE_BITS), nth)
        return F.shiftleft(h, PLACE_BITS).bitwiseOR(x.bitwiseAND(F.lit(PLACE)))

    def number(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (
            F.shiftright(F.get(s, i), PLACE_BITS) != F.shiftright(F.get(s, i - 1), PLACE_BITS)))

        def by_run(r: Column) -> Column:
            ends = F.concat(F.slice(r, 2, F.size(r)), F.array(n))
            counts = F.flatten(F.zip_with(r, ends, lambda a, b: F.sequence(F.lit(1), b - a)))
            return F.when(F.size(r) == n, F.transform(s, lambda x: item(x, F.lit(1)))).otherwise(F.zip_with(s, counts, item))

        return F.when(n > 0, let(starts, by_run)).otherwise(s)

    return let(F.sort_array(packed), number)


def _sketches(items: Column) -> Column:
    """Array of ``SKETCHES`` tuple hashes; for no items, an array of zeros."""
    step = (1 << 64) // SKETCHES
    marks = F.array(*(F.lit((-(1 << 63) + i * step) | PLACE) for i in range(SKETCHES)))

    def select(ring: Column) -> Column:
        """``ring``: items and marks in order of their hashes."""
        n = F.size(ring) - SKETCHES
        at = F.filter(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: F.get(ring, i).bitwiseAND(F.lit(PLACE)) == PLACE)
        only = F.filter(ring, lambda x: x.bitwiseAND(F.lit(PLACE)) != PLACE)
        size = F.least(F.lit(TUPLE), n)

        def tuples(around: Column) -> Column:
            def one(mark: Column, i: Column) -> Column:
                picked = F.slice(around, mark - i + 1, size)
                by_place = F.sort_array(F.transform(picked, lambda x: F.shiftleft(x, 64 - PLACE_BITS).bitwiseOR(
                    F.shiftrightunsigned(x, PLACE_BITS))))
                return F.xxhash64(F.transform(by_place, lambda y: y.bitwiseAND(F.lit((1 << (64 - PLACE_BITS)) - 1))))

            return F.transform(at, one)

        return F.when(n > 0, let(let(only, lambda t: F.concat(t, F.slice(t, 1, TUPLE))), tuples)).otherwise(
            F.array_repeat(F.lit(0).cast("long"), SKETCHES))

    return let(let(items, lambda x: F.sort_array(F.concat(x, marks))), select)


def signature(text: Column) -> Column:
    """Array of ``SKETCHES`` longs of the whole text (null: as empty)."""
    return _sketches(_numbered(_kmers(F.transform(_units(text), lambda w: F.xxhash64(w)))))


def fingerprint(sig: Column) -> Column:
    """The signature as a string, eight hex digits a sketch."""
    return F.array_join(F.transform(sig, lambda h: F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches, 0 to 1."""
    return F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"] == p["y"])) / F.lit(float(SKETCHES))


def _leading(text: Column, skip: Column | int, n: int) -> Column:
    """The ``n`` bytes of a text after the first ``skip`` as a number that sorts as they do."""
    start = F.lit(skip) + 1
    return F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), start, F.lit(n))), 2 * n, "0"), 16, 10).cast("long")


def _number(docs: DataFrame) -> Column:
    """``key`` as a number that never falls while keys rise: itself, or of other types the seven bytes of its text that
    follow what all keys begin with."""
    if isinstance(docs.schema["key"].dataType, T.NumericType):
        return F.col("key")
    low, high = docs.agg(F.min("key").cast("string").cast("binary"), F.max("key").cast("string").cast("binary")).first()
    same = next((i for i, (a, b) in enumerate(zip(low or b"", high or b"")) if a != b), min(len(low or b""), len(high or b"")))
    return _leading(F.col("key").cast("string"), same, 7)


def _ranges(docs: DataFrame, tasks: int) -> Column:
    """Number of the key range of a row: ranges follow the key order, null last, ``TASK_RANGES`` for each of ``tasks``, of about
    equally many rows where keys are spread. ``QUANTILES`` numbers reach the driver; equal widths part what lies between
    two of them. A whole number that is several quantiles, and the null key, are parted by the first bytes of the text."""
    k, kind = _number(docs), docs.schema["key"].dataType
    found = [int(x) for x in docs.select(k.cast("double").alias("k")).approxQuantile(
        "k", [i / QUANTILES for i in range(QUANTILES + 1)], 1 / (4 * QUANTILES)) if x is not None and math.isfinite(x)]
    bounds, parts = sorted(set(found)) or [0], max(1, -(-TASK_RANGES * tasks // QUANTILES))
    heavy = [x for x in bounds if found.count(x) > 1] if isinstance(kind, T.IntegralType) else []
    part = F.coalesce(_leading(F.col("text"), 0, 2), F.lit(0))
    low = F.array(*(F.lit(b).cast("long") for b in bounds))

    def place(q: Column) -> Column:
        least, above = F.get(low, q), F.get(low, q + 1)
        width = F.greatest(F.lit(1), F.ceil((above - least) / F.lit(parts)))
        inner = F.floor((k - least) / width).cast("long")
        inner = F.when(above.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(parts - 1), inner)))
        side = F.when(k < least, 0).when(k.isin(heavy) if heavy else F.lit(False), 1).otherwise(2)
        return (q * parts + inner) * 3 + side

    quantile = F.greatest(F.lit(0), F.size(F.filter(low, lambda b: b <= k)) - 1)
    at = let(quantile.cast("long"), place)
    return (F.when(F.col("key").isNull(), F.lit(3 * len(bounds) * parts + 3) * PARTS + part)
            .when(at % 3 == 1, at * PARTS + part).otherwise(at * PARTS))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, next_text, _range, _tail): each row's text beside that of the row next by key, the last row's
    beside the first's; equal keys follow by text, null keys come last. Keys are of any type that sorts.

    Rows are dealt once by key range, to as many tasks as their number asks for. A range's last row needs the first of
    the next range, so first rows go to the range before as well, as ``_tail`` rows, which the caller drops. The first
    rows of the ranges, their texts cut to 64 characters, come from a scan of its own; those of at most ``KNOWN``
    expected ranges are broadcast, of more joined by shuffle. Rows of one repeated key with one text are one range.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(usual, -(-slim.count() // TASK_ROWS))
    begins = F.struct(F.col("key"), F.substring("text", 1, 64).alias("text"))
    dealt = slim.withColumn("_range", _ranges(slim, tasks))
    ranges = Window.orderBy("_range")
    around = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = (dealt.groupBy("_range").agg(F.min(begins).alias("_first"))
              .select(F.col("_range").alias("_own"), "_first",
                      F.coalesce(F.lag("_range").over(ranges), F.last("_range").over(around)).alias("_before")))
    firsts = F.broadcast(firsts) if TASK_RANGES * tasks <= KNOWN else firsts
    doubled = dealt.join(firsts, F.col("_range") == F.col("_own"), "left").select(
        "key", "text", F.explode(F.when(begins.eqNullSafe(F.col("_first")), F.array(
            F.struct(F.col("_range").alias("r"), F.lit(0).alias("tail")), F.struct(F.col("_before").alias("r"), F.lit(1).alias("tail"))))
            .otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("tail"))))).alias("to"))
    laid = doubled.select("key", "text", F.col("to.r").alias("_range"), F.col("to.tail").alias("_tail"))
    laid = laid.repartition(tasks, "_range") if tasks > usual else laid
    return laid.withColumn("next_text", F.lead(F.coalesce("text", F.lit(""))).over(in_order()))


def in_order() -> Window:
    return Window.partitionBy("_range").orderBy("_tail", F.col("key").asc_nulls_last(), "text")


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited, sig, edited_sig, next_sig) of every row: the signatures of its text, of its text with
    the last ``floor(n_chars / 2)`` code points replaced by the first as many of the next row's text, and of the
    next row's text. Nulls count as empty texts; extra columns are ignored; an empty table gives no rows; repeated
    rows follow each other."""
    own = F.coalesce("text", F.lit(""))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(own, F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    pairs = with_next(docs, key, text).withColumn("n_chars", F.char_length(own).cast("long")).withColumn("edited", F.when(F.col("_tail") == 0, edited))
    signed = pairs.select("key", "n_chars", "edited", "_range", "_tail", "text", signature(own).alias("sig"),
                          F.when(F.col("_tail") == 0, signature(F.col("edited"))).alias("edited_sig"))
    return (signed.withColumn("next_sig", F.lead("sig").over(in_order())).where("_tail = 0")
            .select(F.col("key").alias(key), "n_chars", "edited", "sig", "edited_sig", "next_sig"))
