"""Stages as recorded runs: a run row opens, the stage's rows are written once, the run row closes or says why not."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text
from attesta.operators import batches, extraction, planning, scoring, writes
from attesta.operators.profile import LINEAGE
from attesta.schema import COMPONENT, RUN, SCORE, SIGNAL
from attesta.sources import store

SCHEMAS = {"run": RUN, "signal": SIGNAL, "score": SCORE, "score_component": COMPONENT}
#: What makes a row of a table the same row: a stage that is run again writes nothing twice.
KEYS = {"signal": ["run_id", "company_id", "key", "evidence_url"], "score": ["run_id", "company_id", "phase"], "score_component": ["score_id", "rule_id"]}
REASON_CHARS = 500


def record(spark: SparkSession, root: str, stage: str, now: datetime, work: Callable[[int], dict[str, DataFrame]]) -> int:
    """Run ``work(run_id)`` as a run of ``stage`` and write the rows that it returns by table; returns the run's id.

    The run row is there from the start and gets ``finished_at`` only after all tables are written; an
    error leaves it with ``aborted_reason`` and is raised again.
    """
    runs = store.latest(spark, f"{root}/run", RUN)
    run_id = (runs.agg(F.max("id")).first()[0] or 0) + 1
    opened = spark.createDataFrame([(run_id, stage, now)], "id bigint, stage string, started_at timestamp")
    store.swap(runs.unionByName(opened, allowMissingColumns=True), f"{root}/run")
    try:
        for name, rows in work(run_id).items():
            append(spark, root, name, rows)
    except Exception as error:
        _close(spark, root, run_id, aborted_reason=F.lit(f"{type(error).__name__}: {error}"[:REASON_CHARS]))
        raise
    _close(spark, root, run_id, finished_at=F.lit(now).cast("timestamp"))
    return run_id


def _close(spark: SparkSession, root: str, run_id: int, **values: Column) -> None:
    runs = store.latest(spark, f"{root}/run", RUN)
    store.swap(runs.select(*[F.when(F.col("id") == run_id, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in runs.columns]), f"{root}/run")


def append(spark: SparkSession, root: str, name: str, rows: DataFrame) -> None:
    """Add the rows whose key the table does not have yet. A null in a key is a value like any other."""
    old = store.latest(spark, f"{root}/{name}", SCHEMAS[name])
    if "id" in old.columns and "id" not in rows.columns:
        rows = rows.withColumn("id", F.lit((old.agg(F.max("id")).first()[0] or 0) + 1) + F.monotonically_increasing_id())
    columns = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in old.dtypes]
    keys = KEYS[name]
    fresh = writes.first_of(rows.select(*columns), keys, [F.lit(1)])
    store.swap(writes.insert_not_exists(old, fresh, keys), f"{root}/{name}")


def facts(rows: DataFrame, run_id: int, now: datetime, method: str = "deterministic") -> DataFrame:
    """(company_id, key, value_num, value_text) as signals of a run, with confidence 1 unless stated."""
    confidence = F.col("confidence") if "confidence" in rows.columns else F.lit(1.0)
    return rows.withColumns({"run_id": F.lit(run_id).cast("long"), "method": F.lit(method), "confidence": confidence, "observed_at": F.lit(now).cast("timestamp")})


def extract(spark: SparkSession, root: str, pages: DataFrame, now: datetime) -> int:
    """Homepage facts of (company_id, html, domain, url) as a run of ``extract_p1``."""
    def work(run_id: int) -> dict[str, DataFrame]:
        found = extraction.homepage_facts(pages).join(pages.select("company_id", F.col("url").alias("evidence_url")), "company_id")
        return {"signal": facts(found, run_id, now)}

    return record(spark, root, "extract_p1", now, work)


def _long(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Facts by name in the profile, where they are measured."""
    def fact(name: str, value: Column) -> Column:
        key, slot = LINEAGE[name] if name in LINEAGE else (name, "value_text")
        return F.struct(F.lit(key).alias("key"), *[(value if s == slot else F.lit(None)).cast(kind).alias(s) for s, kind in (("value_num", "double"), ("value_text", "string"))])

    long = F.filter(F.array(*[fact(n, v) for n, v in values.items()]), lambda f: f["value_num"].isNotNull() | f["value_text"].isNotNull())
    return rows.select("company_id", F.explode(long).alias("f")).select("company_id", "f.*")


def pagespeed(spark: SparkSession, root: str, payloads: DataFrame, now: datetime) -> int:
    """Performance scores out of (company_id, payload) as a run of ``pagespeed``; a payload without a score writes nothing."""
    read = payloads.withColumn("read", planning.lighthouse(F.col("payload")))
    return record(spark, root, "pagespeed", now, lambda run_id: {"signal": facts(_long(read, {"lighthouse_perf": F.col("read.score")}), run_id, now)})


def ai_check(spark: SparkSession, root: str, answers: DataFrame, companies: DataFrame, now: datetime) -> int:
    """Mentions in (company_id, query_no, query, answer, brands, model) as a run of ``ai_check``, with the basis of the claim.

    ``companies``: id, domain, legal_name. ``brands``: the names that an answer lists, in order.
    """
    terms = companies.select(F.col("id").alias("company_id"), text.brand_terms(F.col("domain"), F.col("legal_name")).alias("terms"))
    judged = answers.join(terms, "company_id").withColumn("hit", text.mentioned(F.col("answer"), F.col("terms")))
    listed = judged.select("company_id", "query_no", "terms", F.posexplode(text.brands(F.col("brands"))).alias("position", "brand")).where(~text.mentioned(F.col("brand"), F.col("terms")))
    from attesta.operators.verification import competitors

    others = competitors(listed).select("company_id", F.array_join("brands", ", ").alias("others"))
    asked = judged.groupBy("company_id").agg(
        F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.max("model").alias("model"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("query_no", "query"))), lambda q: q["query"]), " | ").alias("queries"),
    ).join(others, "company_id", "left")
    values = {
        "ai_queries_checked": F.col("n"), "ai_brand_mentions": F.col("hits"), "ai.competitors_mentioned": F.col("others"), "ai.query_text": F.col("queries"), "ai.model_used": F.col("model"),
        "ai.checked_at": F.lit(now.date().isoformat()),
    }
    return record(spark, root, "ai_check", now, lambda run_id: {"signal": facts(_long(asked, values), run_id, now)})


def score(spark: SparkSession, root: str, profiles: DataFrame, phase: int, now: datetime, version: str) -> int:
    """Scores of all companies that are not excluded as a run of ``score-p1`` or ``score-p2``, evaluated on the day of ``now``."""
    def work(run_id: int) -> dict[str, DataFrame]:
        kept = profiles.where(~F.coalesce("excluded", F.lit(False)))
        # A run scores a company once, so both together make the id.
        scored = scoring.evaluate(kept, now.date().isoformat()).withColumn("score_id", F.xxhash64(F.lit(run_id), "id"))
        rows = scored.select(F.col("score_id").alias("id"), F.lit(run_id).cast("long").alias("run_id"), F.col("id").alias("company_id"), F.lit(phase).alias("phase"), "total", "band", F.lit(version).alias("ruleset_version"), F.lit(now).cast("timestamp").alias("computed_at"), "evaluated_on")
        return {"score": rows, "score_component": scored.select("score_id", F.explode("components").alias("c")).select("score_id", "c.rule_id", "c.points", "c.reason")}

    return record(spark, root, f"score-p{phase}", now, work)


def reconcile(spark: SparkSession, root: str, requests: DataFrame, items: DataFrame, payloads: DataFrame, fields: dict[str, str], now: datetime) -> DataFrame:
    """Settle open requests and write the claims of (batch_id, custom_id, page, fields...) under the run that submitted them.

    ``requests``: batch_id, custom_id, company_id, run_id, artifact_id, evidence_url, outcome. Returns the settled
    requests. Running it again changes nothing: settled requests keep their outcome, signals their keys.
    """
    settled = batches.settled(requests, items)
    done = settled.where("outcome = 'succeeded'").select("batch_id", "custom_id", "company_id", "run_id", "artifact_id", "evidence_url")
    mine = payloads.join(done, ["batch_id", "custom_id"])
    # A request's origin travels with its claims.
    origin = mine.withColumn("company_id", F.struct("company_id", "run_id", "artifact_id", "evidence_url"))
    found = batches.claims(origin, fields, F.col("page"), tuple(fields.values()))
    rows = found.select("company_id.*", "key", "value_text", "confidence").withColumns({"method": F.lit("llm"), "observed_at": F.lit(now).cast("timestamp")})
    append(spark, root, "signal", rows)
    return settled
