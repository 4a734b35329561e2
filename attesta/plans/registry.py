"""All queries of the evidence engine by name, with their SQL where SQL can express them."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "ranked_scores"


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir); ``sql`` gives the same rows in DuckDB."""
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from attesta.plans import commerce, evidence, extras, proofs, requests, stages, web  # noqa: E402, F401  each registers its queries
