"""Review flags, what they block, exclusion, retention and erasure - as state derived from appended events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.schema import CHANNELS


def to_raise(wanted: DataFrame, flags: DataFrame) -> DataFrame:
    """The (company_id, reason) rows that may be raised: a reason once raised, resolved or not, is never raised again."""
    return wanted.dropDuplicates(["company_id", "reason"]).join(flags, ["company_id", "reason"], "left_anti")


def flag_state(events: DataFrame) -> DataFrame:
    """(company_id, reason, at, resolves) -> one row a flag: first raising, last resolution if any."""
    return events.groupBy("company_id", "reason").agg(F.min("at").alias("raised_at"), F.max(F.when(F.col("resolves"), F.col("at"))).alias("resolved_at"), F.count("*").alias("raises"))


def derived(companies: DataFrame, flags: DataFrame, blocking: DataFrame) -> DataFrame:
    """``companies`` with needs_review (an open flag), contact_blocked (an open flag of a blocking reason) and open_flags."""
    known = blocking.select("reason", F.lit(True).alias("blocks"))
    open_ = flags.where("resolved_at is null").join(known, "reason", "left").groupBy(F.col("company_id").alias("id")).agg(F.lit(True).alias("needs_review"), F.coalesce(F.bool_or("blocks"), F.lit(False)).alias("contact_blocked"), F.count("*").alias("open_flags"))
    return companies.join(open_, "id", "left").fillna(False, ["needs_review", "contact_blocked"]).fillna(0, ["open_flags"])


def outreach_violations(outreach: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows of ``outreach`` that must not be appended, with the first reason against them."""
    state = companies.select(F.col("id").alias("company_id"), "excluded", "contact_blocked")
    reason = F.when(F.col("excluded"), "excluded").when(F.col("contact_blocked"), "blocked").when(~F.col("channel").isin(*CHANNELS), "channel")
    return outreach.join(state, "company_id").withColumn("violation", reason).where("violation is not null")


def resolved(flags: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Open flags take the first resolution given for them; resolved ones stay as they are."""
    first = resolutions.groupBy("company_id", "reason").agg(F.min("at").alias("at"))
    return flags.join(first, ["company_id", "reason"], "left").withColumn("resolved_at", F.coalesce("resolved_at", "at")).drop("at")


def excluded(companies: DataFrame, decisions: DataFrame) -> DataFrame:
    """The newest (company_id, at, exclude, reason) decides; an exclusion without a reason is an error."""
    checked = decisions.withColumn("reason", F.when(F.col("exclude") & (F.coalesce(F.trim("reason"), F.lit("")) == ""), F.raise_error(F.lit("an exclusion needs a reason"))).otherwise(F.when(F.col("exclude"), F.col("reason"))))
    last = checked.groupBy(F.col("company_id").alias("id")).agg(F.max_by(F.struct("exclude", "reason"), "at").alias("d"))
    out = companies.join(last, "id", "left")
    return out.withColumn("excluded", F.coalesce("d.exclude", "excluded")).withColumn("excluded_reason", F.when(F.col("d").isNotNull(), F.col("d.reason")).otherwise(F.col("excluded_reason"))).drop("d")


def purged(contacts: DataFrame, now) -> DataFrame:
    """What stays after the retention run: contacts that may be kept until ``now`` or longer, or without a limit."""
    return contacts.where(F.col("purge_after").isNull() | (F.col("purge_after") >= now))


def forget(spark: SparkSession, company_id: int, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """Every catalogued table with a ``company_id`` (and ``company`` by id) without that company's rows."""
    out = {}
    for name in tables or [t.name for t in spark.catalog.listTables()]:
        columns = {c.name for c in spark.catalog.listColumns(name)}
        key = "company_id" if "company_id" in columns else "id" if name == "company" else None
        if key:
            out[name] = spark.table(name).where(~F.col(key).eqNullSafe(F.lit(company_id)))
    return out


def residue(tables: dict[str, DataFrame], company_id: int) -> DataFrame:
    """(table, rows) that still hold the company: all zero is the proof of erasure.

    Components of scores name no company; they are counted through the score that they belong to.
    """
    if "score_component" in tables and "score" in tables:
        owner = tables["score"].select(F.col("id").alias("score_id"), "company_id")
        tables = tables | {"score_component": tables["score_component"].select("score_id").join(owner, "score_id")}
    counts = [df.select(F.lit(name).alias("table"), (F.col("company_id" if "company_id" in df.columns else "id") == company_id).cast("int").alias("hit")) for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("table").agg(F.sum("hit").alias("rows"))


def site_owner(claims: DataFrame) -> DataFrame:
    """(host, company_id, seeded) -> the owner of each host: a seeded company before others, then the lowest id."""
    rank = F.struct((~F.col("seeded")).cast("int"), "company_id")
    return claims.groupBy("host").agg(F.min_by("company_id", rank).alias("owner"), F.count("*").alias("claims"))


def rivals(companies: DataFrame) -> DataFrame:
    """Pairs of different companies of which one claims the other's host: two equi-joins instead of a disjunction."""
    hosts = companies.select("id", F.explode(F.array_distinct(F.array_compact(F.array("domain", "site_domain")))).alias("host"))
    other = hosts.select(F.col("id").alias("rival"), "host")
    return hosts.join(other, "host").where("id <> rival").select("id", "rival", "host").distinct()


def manufacturers(companies: DataFrame, facts: DataFrame) -> DataFrame:
    """Companies found by web search whose page has no cart marker and that list no product."""
    seen = facts.groupBy(F.col("company_id").alias("id")).agg(F.max(F.when(F.col("key") == "shop.cart_absent", F.col("value_num"))).alias("cart_absent"), F.max(F.when(F.col("key") == "catalog.product_url_count", F.col("value_num"))).alias("products"))
    return companies.where("discovery_source = 'llm_websearch'").join(seen, "id").where("cart_absent = 1 and coalesce(products, 0) = 0").select("id")


def next_steps(companies: DataFrame, artifacts: DataFrame, scores: DataFrame, flags: DataFrame) -> DataFrame:
    """(step, companies): how many wait to be fetched, scored and reviewed."""
    keep = companies.where(~F.coalesce("excluded", F.lit(False))).select(F.col("id").alias("company_id"))
    have = artifacts.select("company_id").distinct()
    steps = {
        "fetch": keep.join(have, "company_id", "left_anti"),
        "score": keep.join(have, "company_id", "left_semi").join(scores.select("company_id").distinct(), "company_id", "left_anti"),
        "review": keep.join(flags.where("resolved_at is null").select("company_id").distinct(), "company_id", "left_semi"),
    }
    out = None
    for name, rows in steps.items():
        one = rows.select(F.lit(name).alias("step"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("step").agg(F.count("*").alias("companies"))


def first_of(rows: DataFrame, keys: list[str], order) -> DataFrame:
    """Insert-if-absent within one batch: the first row of each key."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")
