"""Quality evaluation: metrics over labelled claims, strata, leakage, thresholds and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(hit: Column, of: Column, places: int = 6) -> Column:
    """Share of rows of `of` that also `hit`; null where there are none."""
    return F.round(F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0)), places)


def precision_recall(rows: DataFrame, predicted: Column, truth: Column, keys: Sequence[str] = ()) -> DataFrame:
    both = F.count_if(predicted & truth)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), both.alias("true_positives"), ratio(truth, predicted).alias("precision"), ratio(predicted, truth).alias("recall"))


def leakage(rows: DataFrame, key: str, partition: str) -> DataFrame:
    """Keys that occur in more than one partition."""
    return rows.groupBy(key).agg(F.countDistinct(partition).alias("n_partitions"), F.count("*").alias("n_rows")).where("n_partitions > 1")


def blockers(metrics: DataFrame, thresholds: dict[str, float], keys: Sequence[str]) -> DataFrame:
    """(keys, metric, value, threshold): what falls short of its threshold, or is not measured."""
    pairs = ", ".join(f"'{m}', {m}, {t}D" for m, t in thresholds.items())
    return metrics.selectExpr(*keys, f"stack({len(thresholds)}, {pairs}) AS (metric, value, threshold)").where("value IS NULL OR value < threshold")


def gate(reasons: dict[str, Column]) -> tuple[Column, Column]:
    """(status, reasons): BLOCKED with the names of the conditions that hold, in order, or PASS."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in reasons.items()]))
    return F.when(F.size(found) == 0, "PASS").otherwise("BLOCKED"), found
