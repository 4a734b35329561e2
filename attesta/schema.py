"""Explicit schemas of the engine's tables, and the vocabularies that their columns are held to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPANY = (
    "id bigint, domain string, legal_name string, legal_form string, city string, postal_code string, country string, discovery_source string,"
    " discovery_query string, discovered_at timestamp, excluded boolean, excluded_reason string, site_domain string"
)
ARTIFACT = "id bigint, company_id bigint, kind string, url string, http_status int, content_hash string, body binary, bytes bigint, fetched_at timestamp, last_checked_at timestamp, error string"
SIGNAL = (
    "id bigint, company_id bigint, run_id bigint, key string, value_text string, value_num double, value_date date, method string, confidence double,"
    " evidence_url string, artifact_id bigint, observed_at timestamp"
)
RUN = "id bigint, stage string, started_at timestamp, finished_at timestamp, est_cost_usd double, aborted_reason string, country string"
SCORE = "id bigint, run_id bigint, company_id bigint, phase int, total int, band string, ruleset_version string, computed_at timestamp, evaluated_on date"
COMPONENT = "score_id bigint, rule_id string, points int, reason string"
REVIEW_FLAG = "company_id bigint, reason string, raised_run_id bigint, raised_at timestamp, raised_note string, resolved_at timestamp, resolved_by_human boolean, resolved_note string"
CONTACT = "id bigint, company_id bigint, name string, role string, source_url string, collected_at timestamp, purge_after timestamp"
OUTREACH = "id bigint, company_id bigint, channel string, occurred_at timestamp, notes string, outcome string"
BATCH = "id bigint, run_id bigint, purpose string, status string, request_count int, est_cost_usd double, actual_cost_usd double, reserved_at timestamp, submitted_at timestamp, reconciled_at timestamp, released_at timestamp"
BATCH_REQUEST = "batch_id bigint, custom_id string, company_id bigint, artifact_id bigint, sent_text_sha256 string, sent_bytes bigint, outcome string, settled_at timestamp"

# The domains that columns are held to.
COUNTRIES = ("DE", "AT", "CH", "LU")
METHODS = ("deterministic", "llm")
PHASES = (1, 2)
BANDS = ("A", "B", "C", "D")
CHANNELS = ("post", "phone")

#: table -> (name of the rule, violation as SQL); a row that makes the violation true breaks the rule.
CHECKS = {
    "company": [("country", f"country is not null and country not in {COUNTRIES}"), ("excluded_reason", "excluded and coalesce(trim(excluded_reason), '') = ''")],
    "signal": [("method", f"method not in {METHODS}"), ("confidence", "confidence < 0 or confidence > 1")],
    "score": [("phase", f"phase not in {PHASES}"), ("band", f"band not in {BANDS}"), ("evaluated_on", "evaluated_on is null")],
    "review_flag": [("resolved_pair", "(resolved_at is null) <> (resolved_by_human is null)")],
    "outreach": [("channel", f"channel not in {CHANNELS}")],
    "llm_batch": [("released", "status = 'released' and released_at is null"), ("reconciled", "status = 'reconciled' and reconciled_at is null")],
}


def violations(table: str, rows: DataFrame) -> DataFrame:
    """The rows of ``rows`` that break a rule of ``table``, once for each rule, with its name in ``check``."""
    broken = F.array_compact(F.array(*[F.when(F.expr(condition), F.lit(name)) for name, condition in CHECKS[table]]))
    return rows.withColumn("check", F.explode(broken))
