"""Global positions without a single-partition window.

A global ``row_number()`` over a whole corpus puts every row into one task.
Instead, rows are grouped into order-preserving buckets (the leading hex digits
of an md5 key, or ranges between quantiles of the ids); bucket totals are a
small table (per partition key) and get an exclusive running sum; each bucket
then ranks only its own rows. Every step is a function of the data, so a retried
task recomputes the same positions. Every row is kept: NULL ids and keys are
values like others (first in order), and rows with equal ids get neighbouring
positions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of seeded hash keys.
BUCKETS = 1 << 16
#: Ids in the sample whose values bound the ranges, and how many of them a lookup reads at a time.
BOUNDS, STRIDE = 1 << 12, 1 << 6
#: The bucket of NULL ids and keys, before all others.
NULL_BUCKET = -(1 << 62)


def keyed(df: DataFrame, cols: Sequence[str], out: str = "_key_") -> DataFrame:
    """Add the columns as one struct, which is never NULL and in which NULLs are equal: grouping, windows and joins on it
    share one partitioning, where a NULL-safe comparison would deal all rows anew."""
    return df.withColumn(out, F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)]))


def quantiles(df: DataFrame, order_col: str) -> DataFrame:
    """One row ``_bounds``: a sorted uniform sample of at most ``BOUNDS`` different ids, those with the smallest hashes.
    It is the same however often and wherever it is worked out."""
    ids = df.select(F.col(order_col).alias("_v")).where("_v IS NOT NULL").distinct()
    return ids.orderBy(F.xxhash64("_v"), "_v").limit(BOUNDS).agg(F.array_sort(F.collect_list("_v")).alias("_bounds"))


def with_range_bucket(df: DataFrame, order_col: str, out: str = "_bucket", width: int | None = None) -> DataFrame:
    """Add a bucket number that follows ``order_col``: how many quantile bounds lie at or below the id, so that dense,
    sparse, hashed and far-off ids all spread; or buckets of ``width`` ids where the caller knows the ids to be dense.
    NULL ids have a bucket of their own, the first."""
    if width is not None:
        return df.withColumn(out, F.coalesce(F.floor(F.col(order_col) / F.lit(width)).cast("long"), F.lit(NULL_BUCKET)))
    parts = F.transform(F.sequence(F.lit(0), F.lit(BOUNDS // STRIDE - 1)), lambda i: F.slice("_bounds", i * STRIDE + 1, STRIDE))
    ladder = quantiles(df, order_col).select(parts.alias("_parts")).select(
        "_parts", F.filter(F.transform("_parts", lambda p: F.get(p, F.lit(0))), lambda x: x.isNotNull()).alias("_firsts"))
    v = F.col(order_col)
    rung = F.greatest(F.size(F.filter("_firsts", lambda x: x <= v)) - 1, F.lit(0))
    inside = F.size(F.filter(F.get("_parts", F.col("_rung")), lambda x: x <= v))
    bucket = F.when(v.isNull(), F.lit(NULL_BUCKET)).otherwise((F.col("_rung") * STRIDE + inside).cast("long"))
    return (df.crossJoin(F.broadcast(ladder))  # one row of at most BOUNDS ids
            .withColumn("_rung", rung).withColumn(out, bucket).drop("_parts", "_firsts", "_rung"))


def exclusive_prefix_sum(df: DataFrame, order_cols: list[str], bucket, weight=None,
                         out: str = "offset", partition_cols: list[str] | None = None) -> DataFrame:
    """Add ``out`` = sum of ``weight`` over all rows strictly before this one.

    Order is (``partition_cols``) then ``bucket`` then ``order_cols``; ``bucket``
    (a column, or the name of one, dropped) must follow ``order_cols``.
    ``weight`` defaults to 1, which yields a 0-based row index. Rows are dealt
    once, by partition and bucket.
    """
    parts = list(partition_cols or [])
    w = F.lit(1).cast("long") if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("long")
    b = F.coalesce(F.col(bucket) if isinstance(bucket, str) else bucket, F.lit(NULL_BUCKET))
    tagged = keyed(df.withColumn("_bucket", b).withColumn("_w", w), [*parts, "_bucket"])
    totals = tagged.groupBy("_key_").agg(F.sum("_w").alias("_bt"))
    before = _by_bucket(len(parts)).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_key_", F.coalesce(F.sum("_bt").over(before), F.lit(0)).alias("_boff"))
    inside = Window.partitionBy("_key_").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    tagged = tagged.withColumn("_win", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return (tagged.join(totals, "_key_").withColumn(out, (F.col("_boff") + F.col("_win")).cast("long"))
            .drop("_key_", "_bucket", "_w", "_boff", "_win"))


def _by_bucket(n_parts: int):
    """The totals of a partition in the order of their buckets, the last field of their key."""
    return Window.partitionBy(*[f"_key_.k{i}" for i in range(n_parts)]).orderBy(f"_key_.k{n_parts}")


def index_by_int(df: DataFrame, order_col: str, out: str = "idx", width: int | None = None,
                 partition_cols: list[str] | None = None, weight=None) -> DataFrame:
    """Positions in the order of an integer column (ids, line numbers)."""
    return exclusive_prefix_sum(with_range_bucket(df, order_col, width=width), [order_col], "_bucket", weight, out, partition_cols)


def cut_by_position(df: DataFrame, cuts: list[Column], order_cols: list[Column], bucket: str, out: str,
                    partition_cols: list[str] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Add ``out``: how many of the ``cuts`` lie at or below the row's 0-based
    position in the order of ``bucket`` and ``order_cols``.

    Bucket totals tell which rows lie wholly between two cuts; these stream by
    without a shuffle or a rank. Only the few buckets that a cut goes through
    rank their rows. ``cuts`` may read the columns of the one-row ``sizes``.
    """
    parts = list(partition_cols or [])
    df = keyed(df.withColumn(bucket, F.coalesce(F.col(bucket), F.lit(NULL_BUCKET))), [*parts, bucket])
    totals = df.groupBy("_key_").agg(F.count(F.lit(1)).alias("_n"))
    before = _by_bucket(len(parts)).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if sizes is not None:
        totals = totals.crossJoin(F.broadcast(sizes))  # one row

    def passed(pos: Column) -> Column:
        return reduce(lambda a, b: a + b, [(pos >= c).cast("int") for c in cuts])

    totals = totals.select("_key_", "_start", passed(F.col("_start")).alias("_first"),
                           passed(F.col("_start") + F.col("_n") - 1).alias("_last"),
                           *([] if sizes is None else sizes.columns))
    # without partition keys at most BUCKETS + 1 rows
    placed = df.join(totals if parts else F.broadcast(totals), "_key_")
    extra = ["_key_", "_start", "_first", "_last", *([] if sizes is None else sizes.columns)]
    whole = placed.where("_first = _last").withColumn(out, F.col("_first"))
    inside = Window.partitionBy("_key_").orderBy(*order_cols)
    edge = (placed.where("_first <> _last").withColumn("_pos", F.col("_start") + F.row_number().over(inside) - 1)
            .withColumn(out, passed(F.col("_pos"))).drop("_pos"))
    return whole.drop(*extra).unionByName(edge.drop(*extra))


def prefix_agg(df: DataFrame, order_col: str, value_col: str, how: str, out: str,
               partition_cols: list[str] | None = None, width: int | None = None,
               inclusive: bool = True) -> DataFrame:
    """Running ``max`` or ``last`` non-null value in ``order_col`` order per
    partition, without putting a whole partition into one window task.

    A window runs inside each bucket of ``order_col``; bucket summaries are a
    small table whose own running value is the carry-in, and the two are
    combined. ``order_col`` must be an integer unique within a partition.
    """
    parts = list(partition_cols or [])
    v = F.col(value_col)
    tagged = keyed(with_range_bucket(df, order_col, "_bk", width), [*parts, "_bk"])
    end = 0 if inclusive else -1
    inside = Window.partitionBy("_key_").orderBy(order_col).rowsBetween(Window.unboundedPreceding, end)
    before = _by_bucket(len(parts)).rowsBetween(Window.unboundedPreceding, -1)
    if how == "max":
        summary = tagged.groupBy("_key_").agg(F.max(v).alias("_bv"))
        summary = summary.withColumn("_carry", F.max("_bv").over(before))
        local = F.max(v).over(inside)
        combine = F.greatest(F.col("_local"), F.col("_carry"))
    elif how == "last":
        summary = tagged.groupBy("_key_").agg(
            F.max_by(v, F.when(v.isNotNull(), F.col(order_col))).alias("_bv"))
        summary = summary.withColumn("_carry", F.last("_bv", ignorenulls=True).over(before))
        local = F.last(v, ignorenulls=True).over(inside)
        combine = F.coalesce(F.col("_local"), F.col("_carry"))
    else:
        raise ValueError(how)
    tagged = tagged.withColumn("_local", local)
    return (tagged.join(summary.select("_key_", "_carry"), "_key_", "left")
            .withColumn(out, combine).drop("_key_", "_bk", "_local", "_carry"))
