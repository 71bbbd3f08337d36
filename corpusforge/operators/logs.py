"""Training-log metrics: scalar extraction with the current step attached,
best checkpoint and early-stopping point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import prefix_agg

# ---- fixed values: log scalar patterns (group 1 = value unless noted) -------
NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
STEP_PATTERN = r": Up\. ([0-9]+) :"
NAMED_PATTERNS = [
    ("nlines", rf"n_lines: ({NUMBER})"),
    ("oov", rf"({NUMBER}) % of oov tokens"),
    ("BLEU", rf"BLEU\S* = ({NUMBER})"),
    ("lr", rf"L\.r\. ({NUMBER})"),
]
# neighbouring pairs share a colon, which a pair therefore leaves unread
KEY_VALUE_PATTERNS = [
    rf": ([^ \t:]+) : ({NUMBER})(?= :)",
    rf": ([^ \t:]+) ({NUMBER})(?= :)",
]
STEP_KEY = "Up."


def _extract(line, pattern: str, group: int = 1):
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))


def _pair(key, value):
    return F.struct(key.alias("key"), value.cast("double").alias("value"))


def line_scalars(line) -> "F.Column":
    """Array of (key, value): every scalar of the line, named ones first, in
    the order of the patterns and of their places in the line."""
    def named(name: str):
        return lambda v: _pair(F.lit(name), v)

    found = [F.transform(F.regexp_extract_all(line, F.lit(p), 1), named(name)) for name, p in NAMED_PATTERNS]
    for p in KEY_VALUE_PATTERNS:
        pairs = F.arrays_zip(F.regexp_extract_all(line, F.lit(p), 1).alias("k"),
                             F.regexp_extract_all(line, F.lit(p), 2).alias("v"))
        found.append(F.transform(F.filter(pairs, lambda x: x["k"] != STEP_KEY), lambda x: _pair(x["k"], x["v"])))
    return F.concat(*found)


def log_scalars(logs: DataFrame, run_col: str = "run", line_no: str = "line_no",
                line_col: str = "line", width: int | None = None) -> DataFrame:
    """``(run, line_no, step, key, value)`` for every scalar of every line.

    A line that holds ``: Up. N :`` sets the step from itself on (per run, in
    line order); scalars before the first such line get a NULL step.
    """
    line = F.col(line_col)
    tagged = logs.select(run_col, line_no, _extract(line, STEP_PATTERN).cast("long").alias("_step_here"),
                         line_scalars(line).alias("_found"))
    filled = prefix_agg(tagged, line_no, "_step_here", "last", "step", [run_col], width)
    return (filled.select(run_col, line_no, "step", F.explode("_found").alias("x"))
            .select(run_col, line_no, "step", "x.key", "x.value"))


def best_step(metrics: DataFrame, key: str, run_col: str = "run", maximize: bool = True) -> DataFrame:
    """Step with the best value of ``key`` per run (ties: earliest step)."""
    m = metrics.where((F.col("key") == key) & F.col("step").isNotNull())
    v = F.col("value") if maximize else -F.col("value")
    return m.groupBy(run_col).agg(
        F.max_by("step", F.struct(v, -F.col("step"))).alias("best_step"),
        (F.max(v) if maximize else -F.max(v)).alias("best_value"))


def early_stop(metrics: DataFrame, key: str, patience: int = 10, run_col: str = "run",
               order_col: str = "line_no", width: int | None = None) -> DataFrame:
    """First step at which ``key`` has not improved on its best earlier value
    for ``patience`` consecutive validations (per run; NULL if never).

    Validations are the rows of ``key`` in ``order_col`` order; running maxima
    are bucketed prefixes, so one long run does not land in one task. The
    numbered validation series (one row per validation, far smaller than the
    log) is checkpointed once, so the two running maxima do not re-read the
    log.
    """
    from ..session import checkpoint_dir
    from .ordering import index_by_int
    m = metrics.where(F.col("key") == key).select(run_col, order_col, "step", "value")
    m = index_by_int(m, order_col, "idx", width, [run_col])
    checkpoint_dir(m.sparkSession)
    m = m.checkpoint()
    m = prefix_agg(m, "idx", "value", "max", "_prev_best", [run_col], width, inclusive=False)
    m = m.withColumn("_imp_idx", F.when(F.col("_prev_best").isNull() | (F.col("value") > F.col("_prev_best")),
                                        F.col("idx")))
    m = prefix_agg(m, "idx", "_imp_idx", "max", "_last_imp", [run_col], width, inclusive=True)
    stale = F.col("idx") - F.col("_last_imp")
    return m.groupBy(run_col).agg(
        F.min_by("step", F.when(stale >= patience, F.col("idx"))).alias("stop_step"),
        F.count(F.lit(1)).cast("long").alias("n_validations"))
