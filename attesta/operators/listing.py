"""The read model: facets, filters, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def faceted(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that meet every given facet: a value for equality, ``yes`` or ``no`` for booleans; None or '' is no opinion."""
    for name, value in wanted.items():
        if value not in (None, ""):
            boolean = dict(rows.dtypes)[name] == "boolean"
            rows = rows.where((F.coalesce(name, F.lit(False)) == (value == "yes")) if boolean else (F.col(name) == value))
    return rows


def facets(rows: DataFrame, *columns: str) -> DataFrame:
    """(facet, value, n) of all columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def counts(rows: DataFrame, by: str) -> DataFrame:
    """Counts with the missing value last, the largest first."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.col(by).isNull(), F.col("n").desc(), by)


def coverage(rows: DataFrame, entity: str, **conditions: Column) -> DataFrame:
    """One row: distinct entities in all and under each condition, in one aggregation."""
    return rows.agg(F.count_distinct(entity).alias("entities"), *[F.count_distinct(F.when(c, F.col(entity))).alias(n) for n, c in conditions.items()])


def run_state(finished: Column, aborted: Column) -> Column:
    return F.when(aborted.isNotNull(), "aborted").when(finished.isNotNull(), "finished").otherwise("open")


def deadline(submitted: Column) -> Column:
    """The last day on which a batch's results can be fetched."""
    return F.date_add(F.to_date(submitted), 29)


def coerced(rows: DataFrame) -> DataFrame:
    """Summary rows as a page shows them: no null texts, an unscored total 0 with ``scored`` false."""
    texts = [c for c, kind in rows.dtypes if kind == "string"]
    return rows.withColumn("scored", F.col("total").isNotNull()).fillna("", texts).fillna(0, ["total"])
