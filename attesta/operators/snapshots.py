"""Differences between two runs' facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(facts: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """One row a key: its distinct values in order, joined by ``; ``."""
    return facts.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(value)), "; ").alias("value"))


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that appeared, disappeared or changed, with both values."""
    a, b = before.select(*keys, F.col("value").alias("before")), after.select(*keys, F.col("value").alias("after"))
    change = F.when(F.col("before").isNull(), "appeared").when(F.col("after").isNull(), "disappeared").otherwise("changed")
    return a.join(b, keys, "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("change", change)


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def comparable_runs(runs: DataFrame, facts: DataFrame, stage: str, n: int = 2) -> DataFrame:
    """The newest ``n`` runs of a stage that wrote anything."""
    return runs.where(F.col("stage") == stage).join(facts.select(F.col("run_id").alias("id")).distinct(), "id", "left_semi").orderBy(F.col("id").desc()).limit(n)
