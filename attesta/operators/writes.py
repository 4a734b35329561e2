"""Write semantics on append-only tables: what a transactional store does in place is derived here from rows in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators.review import first_of


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], order) -> DataFrame:
    """``existing`` and the first incoming row of each new key; null keys never conflict."""
    fresh = first_of(incoming, keys, order).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The newest row of each key by ``seq``."""
    return first_of(existing.unionByName(incoming), keys, [F.col(seq).desc()])


def fill_if_null(rows: DataFrame, verified: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Nulls of ``columns`` take the verified value (confidence 1); values there stay."""
    offered = verified.where("confidence = 1").select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(offered, keys, "left")
    return joined.select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in rows.columns])


def contents(fetches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content_hash): the first url seen, first and last check, the latest status, and how often it was seen."""
    return fetches.groupBy(*keys, "content_hash").agg(
        F.min_by("url", "seq").alias("url"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by("http_status", "seq").alias("http_status"), F.count("*").alias("fetches")
    )


def failures(fetches: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each url that failed: first failure, last error."""
    return fetches.where("content_hash is null").groupBy(*keys, "url").agg(F.min("seq").alias("first_seq"), F.max_by("error", "seq").alias("error"))


def insert_not_exists(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """New rows by null-safe comparison of ``keys``."""
    e = existing.select(*[F.col(k).alias(f"__{k}") for k in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return existing.unionByName(incoming.join(e, condition, "left_anti"))


def counters(increments: DataFrame, keys: list[str]) -> DataFrame:
    """Counters as sums of their increments; a missing one counts 0."""
    return increments.groupBy(*keys).agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))


def replace_partition(df: DataFrame, path: str, *partitions: str) -> None:
    """Rewrite the partitions that ``df`` has and leave the others: the idempotent form of delete and insert."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
