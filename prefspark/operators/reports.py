"""Evaluation reports: win rates with standard errors (A12), per-model lists
over checkpoints (A13), method deltas (A14), data-scaling curves (A15), the
leaderboard scan and name lookup (S15, J5, F10, T11, T12) and the
right-wins merge of win-rate tables (U4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.functions import text as T

# Fixed run-exclusion rule of the scaling collector: for directories with 'DS_',
# skip those whose path contains any of these.
EXCLUDED_MARKS = ("c2", "epoch-9", "epoch-12")


def win_rates(battles: DataFrame, keys: Sequence[str] = ("generator", "evaluator"), outcome: str = "outcome") -> DataFrame:
    """win = 1, tie = 0.5, loss = 0, null dropped; ``100*avg`` and
    ``100*stddev_samp/sqrt(n)``, one pass with map-side partial aggregation."""
    o = F.col(outcome).cast("double")
    return battles.groupBy(*keys).agg(
        (F.avg(o) * 100).alias("win_rate"),
        (F.stddev_samp(o) * 100 / F.sqrt(F.count(o))).alias("std_err"),
        F.count(o).cast("bigint").alias("n"),
        F.count_if(o == 1.0).cast("bigint").alias("wins"),
        F.count_if(o == 0.5).cast("bigint").alias("ties"),
    )


def checkpoint_pivot(rates: DataFrame, checkpoints: Sequence[str], model: str = "model",
                     evaluator: str = "evaluator", checkpoint: str = "checkpoint") -> DataFrame:
    """Win-rate per model and evaluator, one column per checkpoint (the
    ordered list the reference plots). Pivot values are given, so no extra pass."""
    return rates.groupBy(model, evaluator).pivot(checkpoint, list(checkpoints)).agg(F.first("win_rate"))


def method_deltas(rates: DataFrame, base: str, tuned: str, model: str = "model", method: str = "method",
                  evaluator: str = "evaluator") -> DataFrame:
    """Gain of ``tuned`` over ``base`` per model (pivot on method)."""
    p = rates.groupBy(model, evaluator).pivot(method, [base, tuned]).agg(F.first("win_rate"))
    return p.withColumn("delta", F.col(f"`{tuned}`") - F.col(f"`{base}`"))


def scaling_curve(rates: DataFrame, fraction: str = "fraction", evaluator: str = "evaluator") -> DataFrame:
    """Metric by data fraction and evaluator, with the gain over the previous
    fraction (``lag`` over the few fractions of one evaluator)."""
    w = Window.partitionBy(evaluator).orderBy(fraction)
    return rates.withColumn("gain", F.col("win_rate") - F.lag("win_rate").over(w))


def excluded_run(path_col: str = "run_dir"):
    """a 'DS_' run directory containing c2 / epoch-9 / epoch-12 is skipped."""
    p = F.col(path_col)
    bad = F.lit(False)
    for m in EXCLUDED_MARKS:
        bad = bad | p.contains(m)
    return p.contains("DS_") & bad


def lookup_scores(boards: DataFrame, names: DataFrame) -> DataFrame:
    """For every run, the leaderboard rows whose first column equals the run's
    name; when several match, the last row wins (``max_by`` on the line order)."""
    j = boards.join(names, "run_dir").filter(F.col("c0") == F.col("name"))
    return j.groupBy("run_dir", "name", "evaluator").agg(F.max_by("c1", "line_no").alias("win_rate_text")).select(
        "run_dir", "name", "evaluator", F.col("win_rate_text").cast("double").alias("win_rate"))


def scan_leaderboards(spark, root: str) -> DataFrame:
    """S15+F10+J5 over the evaluation folder layout ``<run>/name.txt`` and
    ``<run>/<evaluator>/leaderboard.csv``: excluded runs are skipped, runs or
    evaluators without files contribute nothing, the last matching row wins."""
    from prefspark.sources import io

    names = io.read_run_names(spark, root).filter(~excluded_run("run_dir"))
    return lookup_scores(io.read_leaderboard_rows(spark, root), names)


def model_of_run(name: str = "name"):
    """``key[len('llama7b_'):-3]``."""
    return T.run_model_name(name)


def merge_right_wins(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """U4: dict merge ``{**left, **right}`` - the right table's row wins per key."""
    tagged = left.withColumn("_src", F.lit(0)).unionByName(right.withColumn("_src", F.lit(1)))
    value_cols = [c for c in left.columns if c not in keys]
    return tagged.groupBy(*keys).agg(
        F.max_by(F.struct(*value_cols), "_src").alias("_v")).select(*keys, "_v.*")
