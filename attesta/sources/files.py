"""File sources: the seed list, the request log, stored bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions import urls
from attesta.schema import COUNTRIES

REQUEST_LOG = "issued_at string, issued_monotonic double, elapsed double, host string, authority string, url string, final_url string, status int, error string"


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """domain, legal_name, city, postal_code, country of a seed CSV with a header; the first row of a domain wins.

    Blank lines and rows whose first field begins with ``#`` are skipped, a byte-order mark is not part
    of the header, domains are normalised and countries upper-cased. A row without a usable domain or
    with an unknown country, a file without rows or without a ``domain`` column fails the load.
    """
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("mode", "FAILFAST").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    if "domain" not in raw.columns:
        raise ValueError("the seed list has no column domain")
    rows = raw.where(F.col("domain").isNotNull() & ~F.trim("domain").startswith("#")).withColumn("nth", F.monotonically_increasing_id())
    columns = {c: (F.trim(c) if c in raw.columns else F.lit(None).cast("string")) for c in ("legal_name", "city", "postal_code")}
    country = F.upper(F.trim("country")) if "country" in raw.columns else F.lit(None).cast("string")
    country = F.nullif(country, F.lit(""))
    host = urls.normalised_domain(F.col("domain"))
    bad = F.concat(F.lit("seed row cannot be used: "), "domain")
    checked = F.when(host.isNull() | (country.isNotNull() & ~country.isin(*COUNTRIES)), F.raise_error(bad)).otherwise(host)
    first = Window.partitionBy("domain").orderBy("nth")
    found = rows.select(checked.alias("domain"), *[c.alias(n) for n, c in columns.items()], country.alias("country"), "nth")
    found = found.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "nth")
    if found.isEmpty():
        raise ValueError("the seed list is empty")
    return found


def request_log(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line in order of issue, blank lines skipped; a malformed line, or one without its time of issue, fails the read."""
    rows = spark.read.schema(REQUEST_LOG).option("mode", "FAILFAST").json(path)
    issued = F.when(F.col("issued_monotonic").isNull(), F.raise_error(F.lit("a request without issued_monotonic")).cast("double")).otherwise(F.col("issued_monotonic"))
    return rows.withColumn("issued_monotonic", issued).orderBy("issued_monotonic")


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """path, body of stored files; text decoding replaces what is not UTF-8."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("body"))


def stored(artifacts: DataFrame, found: DataFrame) -> DataFrame:
    """``artifacts`` (with path) and the decoded ``text`` of their stored bodies, empty where the file is missing."""
    return artifacts.join(found, "path", "left").withColumn("text", decoded(F.col("body"))).drop("body")


def decoded(body: Column) -> Column:
    """A body's text; a missing body is empty, invalid bytes become U+FFFD."""
    return F.coalesce(F.make_valid_utf8(body.cast("string")), F.lit(""))
