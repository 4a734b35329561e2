"""Every registered query with SQL gives the same rows in Spark and DuckDB on the smallest tables; the others run."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__
from attesta.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 3)
    return float(round(v, 3)) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in registry.ORACLES:
        r = duck.sql(registry.ORACLES[name])
        at = [r.columns.index(c) for c in columns]
        assert sorted(r.columns) == columns
        assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "domain", "total", "band", "admitted", "abstained"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pushdown(spark):
    plan = registry.QUERIES["coverage_counts"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderdate" not in plan  # only what the counts read is scanned
    profile = registry.QUERIES["ranked_scores"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in profile and "CartesianProduct" not in profile


def test_pattern_presence_of_letters_beyond_ascii(spark, tmp_path):
    """Address and headings mean in Spark what they mean in the SQL, next to letters and white space beyond ASCII too."""
    import duckdb

    texts = ["x 8114 Réréch a@b.de", "é12345 Bonn a@b.de", "12345\x0bBonn a@b.de", "12345\u00a0Bonn", "12345 Bonn licenſe", "Gesetzliche\x0bAnbieterkennung 53111 Bonn +49 228 1234567", None]
    spark.createDataFrame([(3 * i + k, t) for i, t in enumerate(texts) for k in (1, 2)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.QUERIES["pattern_presence"](spark, str(tmp_path)).select("pattern", "whole", "block").collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(f"select pattern, whole, block from ({registry.ORACLES['pattern_presence']})").fetchall())
