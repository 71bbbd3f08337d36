"""Reproducible shuffles, exact-size splits, head/tail, subsamples.

Order is always ``md5('<seed>:<id>')`` then ``id`` — a total order that is a
pure function of each row (NULL ids first). Splits of any size take the same
path (``ordering.cut_by_position``): totals of hash buckets tell where each cut
falls, and only the buckets that a cut goes through are ranked. A head or tail
is the same rows either way; a short one is left to Spark's top-k, which merges
``n`` rows of each task in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import hash_bucket, hash_key, hash_unit
from .ordering import cut_by_position, exclusive_prefix_sum, with_range_bucket


def shuffle_positions(df: DataFrame, id_col: str, seed: int = 42, out: str = "pos",
                      hex_digits: int = 4, partition_cols: list[str] | None = None) -> DataFrame:
    """Add the 0-based position of every row in the seeded random order.

    Buckets = leading ``hex_digits`` of the md5 key (16**4 = 65,536 by
    default), so each bucket is ~1/65,536 of the rows whatever the skew of the
    ids; raise ``hex_digits`` for trillions of rows.
    """
    keyed = df.withColumn("_key", hash_key(id_col, seed))
    out_df = exclusive_prefix_sum(keyed, ["_key", id_col], hash_bucket(id_col, seed, hex_digits),
                                  None, out, partition_cols)
    return out_df.drop("_key")


def shuffle(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Rows in seeded random order (a distributed range-partitioned sort)."""
    return df.orderBy(hash_key(id_col, seed), F.col(id_col))


# rows up to which one task may merge every task's first rows
TOP_K = 10_000


def _in_shuffle_order(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    return df.withColumn("_bucket", hash_bucket(id_col, seed, 4)).withColumn("_key", hash_key(id_col, seed))


def head(df: DataFrame, n: int, id_col: str, seed: int | None = 42, last: bool = False) -> DataFrame:
    """First (or last) ``n`` rows in seeded order, or in ``id_col`` order when
    ``seed`` is None."""
    if seed is None:
        keyed = with_range_bucket(df, id_col).withColumn("_key", F.lit(0))
    else:
        keyed = _in_shuffle_order(df, id_col, seed)
    order = [F.col("_key"), F.col(id_col)]
    if n <= TOP_K:
        return keyed.orderBy(*[c.desc() if last else c.asc() for c in order]).limit(n).select(*df.columns)
    if last:
        total = df.agg(F.count(F.lit(1)).alias("_total"))
        cut = cut_by_position(keyed, [F.col("_total") - n], order, "_bucket", "_part", sizes=total)
    else:
        cut = cut_by_position(keyed, [F.lit(n)], order, "_bucket", "_part")
    return cut.where(F.col("_part") == int(last)).drop("_part", "_bucket", "_key")


def split_corpus(df: DataFrame, id_col: str, n_val: int = 4096, n_dev: int = 4096, seed: int = 42,
                 split_col: str = "split") -> DataFrame:
    """Shuffle, then first ``n_val`` rows → val, next ``n_dev`` → dev, rest →
    train; as many rows as come in, whatever their ids."""
    cut = cut_by_position(_in_shuffle_order(df, id_col, seed), [F.lit(n_val), F.lit(n_val + n_dev)],
                          [F.col("_key"), F.col(id_col)], "_bucket", "_part")
    names = F.element_at(F.array(F.lit("val"), F.lit("dev"), F.lit("train")), F.col("_part") + 1)
    return cut.withColumn(split_col, names).drop("_part", "_bucket", "_key")


def resplit(train: DataFrame, valid: DataFrame, id_col: str, seed: int = 42,
            split_col: str = "split") -> DataFrame:
    """Merge train and valid, shuffle, give the first |train| rows to train and
    the last |valid| rows to valid. The size comes from a one-row aggregate
    joined lazily (no driver round trip)."""
    size = train.agg(F.count(F.lit(1)).alias("_n_train"))
    cut = cut_by_position(_in_shuffle_order(train.unionByName(valid), id_col, seed), [F.col("_n_train")],
                          [F.col("_key"), F.col(id_col)], "_bucket", "_part", sizes=size)
    return (cut.withColumn(split_col, F.when(F.col("_part") == 0, F.lit("train")).otherwise(F.lit("valid")))
            .drop("_part", "_bucket", "_key"))


def subsample_to(lines: DataFrame, ref_lines: DataFrame, order_col: str = "line_no",
                 split_col: str = "split", group_cols: list[str] | None = None,
                 width: int | None = None) -> DataFrame:
    """Keep the first N train lines (in ``order_col`` order), N = the train size
    of ``ref_lines``; other splits pass unchanged. With ``group_cols`` every
    group (NULL keys form one) is cut to N separately."""
    n_ref = ref_lines.where(F.col(split_col) == "train").agg(F.count(F.lit(1)).alias("_n_ref"))
    train = lines.where(F.col(split_col) == "train")
    rest = lines.where(~F.col(split_col).eqNullSafe("train"))
    cut = cut_by_position(with_range_bucket(train, order_col, width=width), [F.col("_n_ref")], [F.col(order_col)], "_bucket", "_part",
                          group_cols, n_ref)
    return cut.where("_part = 0").drop("_part", "_bucket").unionByName(rest)


def sample_ratio(df: DataFrame, ratio: float, id_col: str, seed: int = 42, line_col: str = "line",
                 first_col: str = "line_no") -> DataFrame:
    """Bernoulli sample: keep a row if its hash draw ≤ ``ratio`` or it is the
    first line; empty lines never survive."""
    keep = (hash_unit(id_col, seed) <= F.lit(ratio)) | (F.col(first_col) == 0)
    return df.where(keep & (F.col(line_col) != ""))


def augment_mix(synthetic: DataFrame, natural: DataFrame, repeat: int = 2, tag: bool = False,
                src_col: str = "src") -> DataFrame:
    """Synthetic pairs once, natural pairs ``repeat`` times (``copy`` says
    which copy), optionally tagging the source side."""
    syn = synthetic.withColumn("origin", F.lit("syn")).withColumn("copy", F.lit(1))
    nat = (natural.withColumn("origin", F.lit("nat"))
           .withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(repeat)))))
    out = syn.unionByName(nat)
    if tag:
        out = out.withColumn(src_col, F.concat(F.concat(F.lit("<"), F.col("origin"), F.lit(">")), F.col(src_col)))
    return out
