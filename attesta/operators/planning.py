"""Planning of paid work and reading of what services return."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text, urls
from attesta.operators.ledger import SEARCH_PRICE

MEASURE_CAP = 100
#: Calls of one places search at most.
PLACES_CALLS = 10


def last_start(runs: DataFrame, stage: str) -> DataFrame:
    """When a stage last began and was not aborted; whether it ended does not matter."""
    return runs.where((F.col("stage") == stage) & F.col("aborted_reason").isNull()).agg(F.max("started_at").alias("started_at"))


def visibility_plan(companies: DataFrame, scores: DataFrame, facts: DataFrame, n: int) -> DataFrame:
    """(id, verdict): the first reason against a check, else ``check`` for the ``n`` best-scored, else ``beyond_limit``; in id order.

    ``facts``: id, category, measured_recently. Unscored companies come last, ties go by domain.
    """
    best = scores.groupBy(F.col("company_id").alias("id")).agg(F.max_by("total", "phase").alias("total"))
    rows = companies.join(best, "id", "left").join(facts, "id", "left")
    against = F.when(F.col("excluded"), "excluded").when(F.col("category").isNull(), "no_category").when(F.coalesce("measured_recently", F.lit(False)), "cached")
    rows = rows.withColumn("against", against)
    chosen = rows.where("against is null").orderBy(F.col("total").isNull(), F.col("total").desc(), "domain").limit(n).select("id", F.lit("check").alias("chosen"))
    return rows.join(chosen, "id", "left").select("id", F.coalesce("against", "chosen", F.lit("beyond_limit")).alias("verdict")).orderBy("id")


def reservation(companies: Column, searches: int, input_tokens: int, output_tokens: int, input_per_mtok: Column, output_per_mtok: Column) -> Column:
    """What ``companies`` calls can cost at most."""
    return companies * (input_tokens / 1e6 * input_per_mtok + output_tokens / 1e6 * output_per_mtok + F.lit(searches * SEARCH_PRICE))


def prepared(selection: DataFrame, gate: DataFrame, artifacts: DataFrame, kind: str, cap: int = text.BYTE_CAP) -> DataFrame:
    """(company_id) -> the newest good page of ``kind`` with its capped text and hash, or why there is none.

    ``gate``: company_id, verdict. ``artifacts``: company_id, artifact_id, kind, http_status, text, at.
    """
    good = artifacts.where((F.col("kind") == kind) & (F.col("http_status") == 200) & (F.coalesce("text", F.lit("")) != ""))
    newest = good.withColumn("rn", F.row_number().over(Window.partitionBy("company_id").orderBy(F.col("at").desc(), F.col("artifact_id").desc()))).where("rn = 1")
    page = newest.select("company_id", "artifact_id", text.capped(F.col("text"), cap).alias("sent"))
    rows = selection.select("company_id").join(gate.select("company_id", "verdict"), "company_id", "left").join(page, "company_id", "left")
    skipped = F.when(F.coalesce("verdict", F.lit("unscored")) != "admitted", F.coalesce("verdict", F.lit("unscored"))).when(F.col("artifact_id").isNull(), "no_page")
    return rows.select("company_id", "artifact_id", F.when(skipped.isNull(), F.col("sent")).alias("sent"), F.when(skipped.isNull(), text.sha256(F.col("sent"))).alias("sent_text_sha256"), skipped.alias("skipped"))


def requests(ready: DataFrame, kind: str) -> DataFrame:
    """One request row a prepared page."""
    return ready.where("skipped is null").select(text.custom_id(F.lit(kind), F.col("company_id"), F.col("artifact_id")).alias("custom_id"), "company_id", "artifact_id", "sent_text_sha256", F.octet_length("sent").cast("bigint").alias("sent_bytes"))


def batch_row(rows: DataFrame, purpose: str, estimate: Column) -> DataFrame:
    """A batch with its requests as one nested row: written at once or not at all."""
    return rows.groupBy(F.lit(purpose).alias("purpose")).agg(F.count("*").alias("request_count"), estimate.alias("est_cost_usd"), F.array_sort(F.collect_list(F.struct("custom_id", "company_id", "artifact_id", "sent_text_sha256"))).alias("requests"))


def open_batches(batches: DataFrame) -> DataFrame:
    return batches.where("submitted_at is not null and reconciled_at is null and released_at is null").orderBy("id")


def unreconciled(batches: DataFrame, requests_: DataFrame, companies: DataFrame) -> DataFrame:
    """Batches whose results a phase-2 score would miss, with the domains they hold."""
    keep = companies.where(~F.coalesce("excluded", F.lit(False))).select(F.col("id").alias("company_id"), "domain")
    rows = open_batches(batches).select(F.col("id").alias("batch_id"), "purpose").join(requests_.select("batch_id", "company_id"), "batch_id", "left").join(keep, "company_id", "left")
    return rows.groupBy("batch_id", "purpose").agg(F.array_join(F.array_sort(F.collect_set("domain")), ", ").alias("domains"))


def cache_write_seen(prompt_tokens: Column, created: Column, least: int = 1024) -> Column:
    """False below the size from which prompts are cached, else whether one was."""
    return F.when(prompt_tokens < least, F.lit(False)).otherwise(created > 0)


def places(payload: Column) -> Column:
    """array<struct<name, website, address>> of a places page; null websites stay."""
    kind = "places array<struct<displayName:struct<text:string>,websiteUri:string,formattedAddress:string>>"
    return F.transform(F.from_json(payload, kind)["places"], lambda p: F.struct(p["displayName"]["text"].alias("name"), p["websiteUri"].alias("website"), p["formattedAddress"].alias("address")))


def lighthouse(payload: Column) -> Column:
    """struct<score, error>: 0 to 100 rounded half to even, or why there is none."""
    raw = F.get_json_object(payload, "$.lighthouseResult.categories.performance.score").try_cast("double")
    code = F.get_json_object(payload, "$.lighthouseResult.runtimeError.code")
    fits = raw.between(0, 1)
    return F.struct(F.when(fits, F.bround(raw * 100, 0)).alias("score"), F.when(~F.coalesce(fits, F.lit(False)), F.coalesce(code, F.when(raw.isNull(), "no score").otherwise("score out of range"))).alias("error"))


def paged(search: Callable[[str | None], str], most: int = PLACES_CALLS) -> tuple[list[str], int, bool]:
    """(payloads, calls issued, whether the cap ended it) of a search that goes on while a page names the next.

    A call counts as issued before its outcome is known; one that fails ends the search with its error.
    """
    payloads: list[str] = []
    token, calls = None, 0
    while calls < most:
        calls += 1
        payloads.append(search(token))
        token = json.loads(payloads[-1]).get("nextPageToken") or None
        if token is None:
            return payloads, calls, False
    return payloads, calls, True


def found_places(payloads: DataFrame, known: DataFrame, region: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(new companies, one report row) out of (page, payload) rows of a places search.

    The first place of a domain counts. Its country is that of its address, else of its domain, else ``region``.
    Places without a website and those with an unusable one are counted, not kept.
    """
    from attesta.operators.verification import address_parts

    rows = payloads.select("page", F.posexplode(places(F.col("payload"))).alias("nth", "p")).select("page", "nth", "p.*")
    rows = rows.withColumn("domain", urls.normalised_domain(F.col("website"))).withColumn("a", address_parts(F.col("address")))
    first = rows.where("domain is not null").groupBy("domain").agg(F.min(F.struct("page", "nth", "name", "a")).alias("f"))
    country = F.coalesce("f.a.country", urls.country(F.col("domain"), F.lit(None).cast("string") if region is None else region))
    fresh = first.join(known.select("domain"), "domain", "left_anti").select("domain", F.nullif(F.col("f.name"), F.lit("")).alias("legal_name"), "f.a.city", "f.a.postal_code", country.alias("country"))
    return fresh, rows.agg(F.count_if(F.coalesce("website", F.lit("")) == "").alias("no_website"), F.count_if((F.col("website") != "") & F.col("domain").isNull()).alias("unusable"))
