"""Paid batches: what may be ordered, what came back, what must be asked again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETRIED = ("server_error", "expired")


def status(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """(batch_id, status) of all expected batches.

    Nothing returned: submitted. Otherwise, in this order: an item out of balance; an expected item that is
    missing (completed); an expired one; a server error (failed); else reconciled.
    """
    items = returned.select("batch_id", "custom_id", "outcome")
    joined = expected.select("batch_id", "custom_id").join(items, ["batch_id", "custom_id"], "left")
    facts = joined.groupBy("batch_id").agg(
        F.count("outcome").alias("back"), F.count("*").alias("expected"), *[F.coalesce(F.bool_or(F.col("outcome") == o), F.lit(False)).alias(o) for o in ("balance_exhausted", "expired", "server_error")]
    )
    state = F.when(F.col("back") == 0, "submitted").when(F.col("balance_exhausted"), "balance_exhausted").when(F.col("back") < F.col("expected"), "completed").when(F.col("expired"), "expired").when(F.col("server_error"), "failed").otherwise("reconciled")
    return facts.select("batch_id", state.alias("status"))


def checked(returned: DataFrame) -> DataFrame:
    """``returned``, or an error where a batch returned one id twice."""
    n = F.count("*").over(Window.partitionBy("batch_id", "custom_id"))
    return returned.withColumn("custom_id", F.when(n > 1, F.raise_error(F.concat(F.lit("returned twice: "), "custom_id"))).otherwise(F.col("custom_id")))


def resubmittable(returned: DataFrame) -> DataFrame:
    return returned.where(F.col("outcome").isin(*RETRIED))


def settled(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Open requests take their first outcome; settled ones keep theirs."""
    first = items.groupBy("batch_id", "custom_id").agg(F.min_by("outcome", "seq").alias("arrived"))
    return requests.join(first, ["batch_id", "custom_id"], "left").withColumn("outcome", F.coalesce("outcome", "arrived")).drop("arrived")


def eligibility(companies: DataFrame, gate: DataFrame) -> DataFrame:
    """(id, verdict): excluded, unscored, stopped or admitted by the newest gate verdict."""
    last = gate.groupBy(F.col("company_id").alias("id")).agg(F.max_by("admitted", "run_id").alias("admitted"))
    verdict = F.when(F.col("excluded"), "excluded").when(F.col("admitted").isNull(), "unscored").when(~F.col("admitted"), "stopped").otherwise("admitted")
    return companies.join(last, "id", "left").select("id", verdict.alias("verdict"))


def cache_plan(targets: DataFrame, measured: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """(id, plan): cached where the newest finished measurement is younger than ``days``, else measure."""
    newest = measured.groupBy("id").agg(F.max("at").alias("at"))
    fresh = F.coalesce(F.col("at") > now - F.make_interval(days=F.lit(days)), F.lit(False))
    return targets.join(newest, "id", "left").select("id", F.when(fresh, "cached").otherwise("measure").alias("plan"))


def within_budget(candidates: DataFrame, n: int) -> DataFrame:
    """The ``n`` best-scored candidates, unscored last, by domain on a tie, with their rank."""
    best = candidates.orderBy(F.col("total").isNull(), F.col("total").desc(), "domain").limit(n)
    order = Window.orderBy(F.col("total").isNull(), F.col("total").desc(), "domain")  # over n rows
    return best.withColumn("rank", F.row_number().over(order))


def releasable(batches: DataFrame, provider: DataFrame) -> DataFrame:
    """Reserved batches that were never submitted and that no provider batch created since could be: only the newest of those decides."""
    mine = batches.where("status = 'reserved' and submitted_at is null and reserved_at is not null")
    newest = provider.agg(F.max("created_at")).first()[0]
    return mine if newest is None else mine.where(F.col("reserved_at") > F.lit(newest))


def reproducible(requests: DataFrame, texts: DataFrame) -> DataFrame:
    """(custom_id, same): whether the stored text still hashes to what was sent."""
    return requests.join(texts, "artifact_id", "left").select("custom_id", (F.sha2(F.col("text").cast("binary"), 256) == F.col("sent_text_sha256")).alias("same"))


def claims(payload: DataFrame, fields: dict[str, str], page: Column, known: tuple[str, ...]) -> DataFrame:
    """Long-form facts of extraction payloads: a text keeps its value with confidence 1 if the page holds it, else 0.

    ``fields``: payload column -> signal key; keys outside ``known`` are an error. Null values write nothing.
    """
    from attesta.functions.text import verified

    if unknown := set(fields.values()) - set(known):
        raise ValueError(f"undeclared keys: {sorted(unknown)}")
    facts = F.array(*[F.struct(F.lit(key).alias("key"), F.nullif(F.trim(c), F.lit("")).alias("value_text")) for c, key in fields.items()])
    long = payload.withColumn("page", page).select("company_id", "page", F.explode(F.filter(facts, lambda f: f["value_text"].isNotNull())).alias("f"))
    return long.select("company_id", "f.key", "f.value_text", verified(F.col("f.value_text"), F.col("page")).cast("double").alias("confidence"))


def outcome_of(http_status: Column, kind: Column) -> Column:
    """What an API error means for a request; an unreadable 403 is an error of its own."""
    return (
        F.when(kind == "billing_error", "balance_exhausted")
        .when(http_status == 429, "rate_limited")
        .when(http_status >= 500, "server_error")
        .when((http_status == 403) & kind.isNull(), F.raise_error(F.lit("403 without a readable body")))
        .when(http_status >= 400, "invalid_request")
        .otherwise("succeeded")
    )
