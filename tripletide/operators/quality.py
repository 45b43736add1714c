"""Scoring answers against a ground truth, and comparing runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripletide.operators.joins import skew_join


def hits(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Answers that are in the ground truth."""
    return skew_join(answers, truth.select("s"), ["s"], "left_semi")


def window_quality(
    answers: DataFrame, truth: DataFrame, by: Sequence[str] = (), windows: DataFrame | None = None
) -> DataFrame:
    """Answers, hits, precision, recall and F1 of every window; zeros where nothing was answered.

    ``windows`` lists the windows that must have a row; without it only windows
    with answers have one.
    """
    by = list(by)
    truth = truth.select("s").distinct()
    found = answers.groupBy(*by).agg(F.count(F.lit(1)).alias("n_results"))
    right = hits(answers, truth).groupBy(*by).agg(F.count(F.lit(1)).alias("hits"))
    counted = found.join(right, by, "left") if by else found.select("n_results", right.scalar().alias("hits"))
    if windows is not None:
        counted = windows.select(*by).distinct().join(counted, by, "left")
    n_truth = truth.agg(F.count(F.lit(1)).alias("n")).scalar()
    scored = counted.select(
        *by,
        F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"),
        F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"),
        n_truth.alias("n_truth"),
    )
    precision, recall = _ratio(F.col("hits"), F.col("n_results")), _ratio(F.col("hits"), F.col("n_truth"))
    return scored.withColumns({"precision": precision, "recall": recall}).select(
        *by,
        "n_results",
        "hits",
        "precision",
        "recall",
        _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("fmeasure"),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


MEASURES = ("precision", "recall", "fmeasure")


def run_average(epoch_metrics: DataFrame, evictions: int | Column | None, by: Sequence[str] = ("config_id",)) -> DataFrame:
    """Macro-average over the ``evictions + 1`` windows of a run; empty windows add nothing.

    With ``evictions=None`` the windows present are averaged.
    """
    if evictions is None:
        windows = F.count(F.lit(1))
    else:
        windows = F.max(evictions) + 1 if isinstance(evictions, Column) else F.lit(evictions + 1)
    return epoch_metrics.groupBy(*by).agg(*[(F.sum(m) / windows).alias(m) for m in MEASURES])


def policy_pivot(
    metrics: DataFrame,
    metric: str,
    rows: str | Sequence[str] = "evict_pct",
    columns: str = "config",
    values: Sequence[str] | None = None,
) -> DataFrame:
    """One metric as a matrix: a row per evict share, a column per setting."""
    return metrics.groupBy(*([rows] if isinstance(rows, str) else rows)).pivot(columns, list(values) if values else None).agg(F.first(metric))
