from __future__ import annotations

from datetime import datetime

import pytest

from attesta.operators import profile as P

T0 = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    companies = spark.createDataFrame([(1, "a.de", None), (2, "b.de", "AG"), (3, "c.de", "KG")], "id bigint, domain string, legal_form string")
    runs = spark.createDataFrame(
        [(1, "p1", T0, T0, None), (2, "p1", T0, T0, None), (3, "p1", T0, None, "stopped"), (4, "p2", T0, T0, None), (5, "p2", T0, T0, None)],
        "id bigint, stage string, started_at timestamp, finished_at timestamp, aborted_reason string",
    )
    row = lambda i, run, key, num=None, text=None, conf=1.0, company=1: (i, company, run, key, text, num, None, "llm", conf, T0)
    signals = spark.createDataFrame(
        [
            row(1, 1, "platform.detected", text="JTL"), row(2, 1, "reviews.count", 7.0),
            row(3, 2, "platform.detected", text="Shopify"), row(4, 2, "platform.detected", text="Shopware"),
            row(5, 3, "platform.detected", text="aborted"),
            row(6, 4, "impressum.gf_count", 2.0), row(7, 5, "impressum.gf_count", 3.0, conf=0.0),
            row(8, 2, "catalog.product_url_count", 12.0, "sitemap"),
            row(9, 4, "impressum.legal_form", text="GbR", company=2),
        ],
        "id bigint, company_id bigint, run_id bigint, key string, value_text string, value_num double, value_date date, method string, confidence double, observed_at timestamp",
    )
    return companies, signals, runs


def test_resolution(tables):
    wide = {r["id"]: r for r in P.profile(*tables).collect()}
    assert set(wide) == {1, 2, 3}
    assert wide[1]["platform"] == "Shopware"  # the newer run, the higher id, not the aborted one
    assert wide[1]["review_count"] is None  # retracted by the newer run
    assert wide[1]["gf_count"] is None  # superseded by a run whose value was rejected
    assert (wide[1]["product_url_count"], wide[1]["product_url_tier"]) == (12.0, "sitemap")
    assert wide[2]["legal_form"] == "GbR" and wide[3]["legal_form"] == "KG"
    assert wide[3]["platform"] is None and wide[3]["blog_post_dates"] == []


def test_evidence_and_rejected(tables):
    _, signals, runs = tables
    shown = {(r["company_id"], r["key"]): r["confidence"] for r in P.evidence(signals, runs).collect()}
    assert shown[(1, "impressum.gf_count")] == 0.0
    assert [(r["company_id"], r["key"]) for r in P.rejected(signals).collect()] == [(1, "impressum.gf_count")]
    lost = {(r["company_id"], r["key"]) for r in P.retracted(signals, runs).collect()}
    assert lost == {(1, "reviews.count")}
