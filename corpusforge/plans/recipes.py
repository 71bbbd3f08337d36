"""Recipes that build parallel corpora: small compositions of the operators, as
datasets are usually prepared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import resplit, sample_ratio, split_corpus, subsample_to
from ..sources.align import relabel_split


def concatenated(corpora: dict[str, DataFrame], id_col: str = "line_no", n_val: int = 4096, n_dev: int = 4096,
                 seed: int = 42) -> DataFrame:
    """Several corpora one after another, each row with its ``origin`` and an
    id of origin and line, then one seeded exact-size split over all."""
    tagged = [df.select(F.lit(name).alias("origin"), F.concat(F.lit(f"{name}:"), F.col(id_col).cast("string")).alias("id"),
                        "src", "tgt") for name, df in corpora.items()]
    return split_corpus(reduce(DataFrame.unionByName, tagged), "id", n_val, n_dev, seed)


def resampled(train: DataFrame, valid: DataFrame, ratio: float, id_col: str = "line_no", seed: int = 42,
              names: dict[str, str] | None = None) -> DataFrame:
    """Train and valid reshuffled into the same sizes, splits renamed, and the
    training rows sampled at ``ratio``."""
    both = relabel_split(resplit(train, valid, id_col, seed), names or {"valid": "val"})
    kept = sample_ratio(both.where(F.col("split") == "train"), ratio, id_col, seed, "src", id_col)
    return kept.unionByName(both.where(F.col("split") != "train"))


def size_matched(pairs: DataFrame, reference: DataFrame, id_col: str = "line_no") -> DataFrame:
    """The "small" variant of a split corpus: its first training rows, as many
    as the reference's; other splits whole."""
    return subsample_to(pairs, reference, id_col, "split")


def evaluation_only(pairs: DataFrame, src_lang: str, tgt_lang: str, models: tuple[DataFrame, DataFrame],
                    id_col: str = "line_no") -> DataFrame:
    """Preparation of a corpus that nothing is fitted on: no row is filtered,
    and the truecasers come from another corpus."""
    from .composites import preprocess_corpus
    return preprocess_corpus(pairs, src_lang, tgt_lang, None, id_col, filter_splits=(), truecase_models=models)
