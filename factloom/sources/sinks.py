"""Writes as DataFrame operations: what a table holds after an insert-ignore, a replacement for a parent, or an append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target and those rows whose key it does not have; of rows with the same key one is taken."""
    return target.unionByName(rows.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti"))


def replace_for_parent(old: DataFrame, new: DataFrame, parent: str, key: str, status: str) -> DataFrame:
    """old with the parents of `new` replaced: their missing rows become SUPERSEDED, others are overwritten; other parents stay."""
    parents = new.select(parent).distinct()
    kept = old.join(new.select(key), key, "left_anti").join(parents.withColumn("__own", F.lit(True)), parent, "left")
    kept = kept.withColumn(status, F.when(F.col("__own"), "SUPERSEDED").otherwise(F.col(status))).drop("__own")
    return kept.select(*old.columns).unionByName(new)


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that df has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
