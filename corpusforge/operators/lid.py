"""Language identification: character n-gram language models fitted and
applied as aggregations and joins.

Model: per language L, add-one smoothed probabilities over the n-gram
vocabulary V of all languages, ``P(g|L) = (c_L(g)+1) / (N_L+|V|)``. A line's
score for L is ``Σ_g ln P(g|L)`` over its n-grams (each line with its
newline). Only grams seen with L need a row in the model, because
``score(L) = Σ_{g seen} ln(c_L(g)+1) − n_grams · ln(N_L+|V|)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import char_windows
from ..session import checkpoint_dir
from .lookup import split_model
from .ordering import keyed
from .rows import map_values

ROUND = 6


def lid_fit(lines: DataFrame, lang_col: str = "lang", line_col: str = "line", n: int = 3,
            materialise: bool = True) -> tuple[DataFrame, DataFrame]:
    """Returns ``(grams, langs)``: ``grams(lang, gram, n, ln_c1)`` and
    ``langs(lang, n_total, ln_denominator)``.

    With ``materialise`` the gram counts (the model: grams × languages, far
    smaller than the corpus) are written once as a reliable checkpoint, so
    predicting several columns and reading the language inventory do not
    refit it."""
    counts = (lines.select(F.col(lang_col).alias("lang"), F.explode(char_windows(line_col, n)).alias("gram"))
              .groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")))
    if materialise:
        from ..session import checkpoint_dir
        checkpoint_dir(lines.sparkSession)
        counts = counts.checkpoint()
    vocab = counts.select("gram").distinct().agg(F.count(F.lit(1)).alias("v"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n_total"))
    langs = (totals.crossJoin(vocab)  # one row per language × one row
             .select("lang", F.col("n_total").cast("long"),
                     F.log(F.col("n_total") + F.col("v")).alias("ln_denominator")))
    grams = counts.select("lang", "gram", F.col("n").cast("long"), F.log(F.col("n") + 1).alias("ln_c1"))
    return grams, langs


@dataclass(frozen=True)
class Inventory:
    """Languages in order, and for each ln of its denominator."""

    names: tuple[str, ...]
    denominators: tuple[float, ...]


def _languages(langs: DataFrame) -> Inventory:
    # one row per language: as many numbers as there are languages
    rows = langs.where("lang IS NOT NULL").orderBy("lang").collect()
    return Inventory(tuple(r["lang"] for r in rows), tuple(float(r["ln_denominator"]) for r in rows))


def gram_rows(grams: DataFrame, inventory: Inventory) -> DataFrame:
    """``(gram, at, ln_c1, n)``: one row a gram, with the places of the languages that have it and their values. The plan
    doesn't widen with the languages, and a gram of one language takes room for one."""
    place = grams.sparkSession.createDataFrame([(n, i) for i, n in enumerate(inventory.names)], "lang string, i int")
    pairs = grams.join(F.broadcast(place), "lang").groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("i", "ln_c1"))).alias("p"), F.sum("n").alias("n"))
    return pairs.select("gram", F.col("p.i").alias("at"), F.col("p.ln_c1").alias("ln_c1"), "n")


def line_sums(lines: DataFrame, grams: DataFrame, inventory: Inventory, id_cols: list[str], line_col: str, n: int,
              carry: Sequence[str] = ()) -> DataFrame:
    """``(id…, carry…, ng, sums)``: the number of n-grams of each line and, for each language, Σ ln(c+1) over them.

    Grams are looked up and summed inside the line; with a model of more than ``lookup.BROADCAST_ROWS`` grams, those that
    are not heavy leave it, meet the model by a join, and their sums come back by line."""
    model = gram_rows(grams, inventory)
    kept = [*id_cols, *carry]
    line = lines.select(*kept, F.col(line_col).cast("string").alias("_line"))
    split = split_model(model, "gram", F.struct("at", "ln_c1"), "n", lambda: line.select(F.explode(char_windows("_line", n)).alias("gram")))
    width, shared = len(inventory.names), lines.sparkSession.sparkContext.broadcast(split)

    def make():
        known, whole = shared.value.known, shared.value.whole
        table = np.zeros((len(known) + 1, width))
        row = {}
        for i, (gram, v) in enumerate(known.items()):
            row[gram] = i
            if v is not None:
                table[i, v["at"]] = v["ln_c1"]

        def run(text):
            text = (text or "") + "\n"
            found = [text[i:i + n] for i in range(len(text) - n + 1)] or [text]
            sums = table[[row.get(g, -1) for g in found]].sum(axis=0)
            return {"ng": len(found), "sums": sums.tolist(), "rest": [] if whole else [g for g in found if g not in row]}
        return run

    kind = T.StructType([T.StructField("ng", T.LongType()), T.StructField("sums", T.ArrayType(T.DoubleType())),
                         T.StructField("rest", T.ArrayType(T.StringType()))])
    done = map_values(line.where("_line IS NOT NULL"), F.col("_line"), "_done", kind, make).select(*kept, "_done.*")
    if split.whole:
        return done.drop("rest")
    checkpoint_dir(lines.sparkSession)
    done = keyed(done, id_cols).checkpoint()  # the grams that leave, and the lines that their sums come back to
    asked = done.select("_key_", F.explode("rest").alias("gram"))
    found = (asked.join(model, "gram").select("_key_", F.explode(F.arrays_zip("at", "ln_c1")).alias("v"))
             .groupBy("_key_", F.col("v.at").alias("i")).agg(F.sum("v.ln_c1").alias("s"))
             .groupBy("_key_").agg(F.map_from_entries(F.collect_list(F.struct("i", "s"))).alias("_more")))
    sums = F.transform("sums", lambda s, i: s + F.coalesce(F.try_element_at("_more", i), F.lit(0.0)))
    return (done.join(found, "_key_", "left").withColumn("sums", F.when(F.col("_more").isNull(), F.col("sums")).otherwise(sums))
            .select(*kept, "ng", "sums"))


def _scores(sums: DataFrame, inventory: Inventory, id_cols: list[str]) -> DataFrame:
    """``(id…, scores)``: by language in order, each with the language's name as ``l`` and the score as ``s``."""
    names, dens = (F.array(*map(F.lit, x)) for x in (inventory.names, inventory.denominators))
    return sums.select(*id_cols, F.transform(F.arrays_zip("sums", names.alias("l"), dens.alias("d")),
                                             lambda x: F.struct((x["sums"] - F.col("ng") * x["d"]).alias("s"), x["l"].alias("l"))).alias("scores"))


def lid_scores(lines: DataFrame, model: tuple[DataFrame, DataFrame], id_cols: list[str],
               line_col: str = "line", n: int = 3) -> DataFrame:
    """``(id…, lang, score)`` for every line and every language."""
    inventory = _languages(model[1])
    scores = _scores(line_sums(lines, model[0], inventory, id_cols, line_col, n), inventory, id_cols)
    return scores.select(*id_cols, F.explode("scores").alias("_x")).select(*id_cols, F.col("_x.l").alias("lang"), F.col("_x.s").alias("score"))


def lid_predict(lines: DataFrame, model: tuple[DataFrame, DataFrame], id_cols: list[str],
                line_col: str = "line", n: int = 3, out: str = "pred", carry: Sequence[str] = ()) -> DataFrame:
    """Most likely language per line (score rounded to 6 decimals; ties → the larger language code), chosen in the row.
    Ids are unique; the columns of ``carry`` come along. A NULL line has no row; with no language at all every
    prediction is NULL."""
    inventory = _languages(model[1])
    sums = line_sums(lines, model[0], inventory, id_cols, line_col, n, carry)
    id_cols = [*id_cols, *carry]
    if not inventory.names:
        return sums.select(*id_cols, F.lit(None).cast("string").alias(out), F.lit(None).cast("double").alias(f"{out}_score"))
    best = F.array_max(F.transform("scores", lambda x: F.struct(F.round(x["s"], ROUND).alias("s"), x["l"].alias("l"))))
    return (_scores(sums, inventory, id_cols).select(*id_cols, best.alias("_b"))
            .select(*id_cols, F.col("_b.l").alias(out), F.col("_b.s").alias(f"{out}_score")))


def label_of(lang_col) -> "F.Column":
    """A fastText-style label line for a language code."""
    return F.concat(F.lit("__label__"), F.col(lang_col) if isinstance(lang_col, str) else lang_col)
