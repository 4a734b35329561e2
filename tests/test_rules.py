"""Each rule's three states over one profile with every input null and one or more overrides."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from attesta.operators import profile as P
from attesta.operators import rules as R
from attesta.operators import scoring

TODAY = date(2026, 8, 15)
SCHEMA = ", ".join(
    f"{n} {'array<date>' if n == 'blog_post_dates' else {'value_num': 'double', 'value_text': 'string', 'value_date': 'date'}[slot]}" for n, (_, slot) in P.LINEAGE.items()
)


def ago(days: int) -> date:
    return TODAY - timedelta(days=days)


CASES = [
    ("qual.ecommerce_platform", {"platform": "JTL"}, "fired"),
    ("qual.ecommerce_platform", {"platform": ""}, "declined"),
    ("qual.owner_operated", {"legal_form": "GbR"}, "fired"),
    ("qual.owner_operated", {"gf_count": 2.0}, "fired"),
    ("qual.owner_operated", {"gf_count": 3.0}, "declined"),
    ("qual.owner_operated", {"gf_count": 0.0}, "declined"),
    ("qual.owner_operated", {"homepage_extracted": 1.0}, "abstained"),
    ("qual.owner_operated", {"homepage_extracted": 1.0, "owner_named": 0.0}, "declined"),
    ("qual.product_depth", {"product_url_count": 20.0}, "fired"),
    ("qual.product_depth", {"product_url_count": 19.0}, "declined"),
    ("qual.own_domain_shop", {"product_url_count": 5.0}, "fired"),
    ("qual.own_domain_shop", {"product_url_count": 4.0}, "declined"),
    ("qual.own_brand", {"own_brand": 1.0}, "declined"),
    ("qual.own_brand", {"own_brand": 1.0, "homepage_extracted": 1.0}, "fired"),
    ("qual.own_brand", {"homepage_extracted": 1.0}, "abstained"),
    ("qual.product_strength", {"review_count": 50.0}, "fired"),
    ("qual.product_strength", {"review_count": 49.0}, "declined"),
    ("opp.no_blog", {"blog_exists": 0.0, "blog_search_exhaustive": 1.0}, "fired"),
    ("opp.no_blog", {"blog_exists": 0.0}, "abstained"),
    ("opp.no_blog", {}, "abstained"),
    ("opp.no_blog", {"blog_exists": 1.0}, "declined"),
    ("opp.blog_stale", {"blog_exists": 1.0, "blog_last_post": ago(366), "blog_last_post_basis": "index"}, "fired"),
    ("opp.blog_stale", {"blog_exists": 1.0, "blog_last_post": ago(366), "blog_last_post_basis": "article"}, "abstained"),
    ("opp.blog_stale", {"blog_exists": 1.0, "blog_last_post": ago(365), "blog_last_post_basis": "index"}, "declined"),
    ("opp.blog_stale", {"blog_exists": 1.0}, "abstained"),
    ("opp.blog_stale", {}, "declined"),  # the ladder ended above
    ("opp.thin_blog", {"blog_exists": 1.0, "blog_last_post": ago(10), "blog_post_count": 9.0}, "fired"),
    ("opp.thin_blog", {"blog_exists": 1.0, "blog_last_post": ago(10), "blog_post_count": 10.0}, "declined"),
    ("opp.blog_slowing", {"blog_exists": 1.0, "blog_last_post": ago(180), "blog_last_post_basis": "both"}, "fired"),
    ("opp.blog_slowing", {"blog_exists": 1.0, "blog_last_post": ago(179), "blog_last_post_basis": "both"}, "declined"),
    ("opp.blog_slowing", {"blog_exists": 1.0, "blog_last_post": ago(200), "blog_last_post_basis": "article"}, "abstained"),
    ("opp.no_article_schema", {"blog_exists": 1.0, "article_schema": 0.0}, "fired"),
    ("opp.no_article_schema", {"blog_exists": 1.0}, "abstained"),
    ("opp.no_article_schema", {"article_schema": 0.0}, "declined"),
    ("opp.no_product_schema", {"product_schema": 0.0}, "fired"),
    ("opp.no_product_schema", {}, "abstained"),
    ("opp.ai_invisible", {"ai_queries_checked": 2.0, "ai_brand_mentions": 0.0}, "fired"),
    ("opp.ai_invisible", {"ai_queries_checked": 2.0}, "declined"),
    ("opp.slow_site", {"lighthouse_perf": 49.0}, "fired"),
    ("opp.slow_site", {"lighthouse_perf": 50.0}, "declined"),
    ("opp.slow_site", {}, "declined"),
    ("opp.de_only", {"hreflang_count": 0.0}, "fired"),
    ("opp.de_only", {"hreflang_count": 2.0}, "declined"),
    ("opp.de_only", {}, "abstained"),
    ("neg.has_agency", {"agency_credit": "Studio"}, "fired"),
    ("neg.has_agency", {"agency_credit": "  "}, "declined"),
    ("neg.active_content", {"blog_exists": 1.0, "blog_post_dates": [ago(i) for i in (1, 2, 3, 180)]}, "fired"),
    ("neg.active_content", {"blog_exists": 1.0, "blog_post_dates": [ago(i) for i in (1, 2, 3, 181)], "blog_post_count": 4.0}, "declined"),
    ("neg.active_content", {"blog_exists": 1.0, "blog_post_dates": [ago(1)], "blog_post_count": 4.0}, "abstained"),
    ("neg.active_content", {"blog_exists": 1.0, "blog_post_dates": [ago(1)]}, "abstained"),
    ("neg.active_content", {"blog_exists": 0.0}, "declined"),
]


@pytest.fixture(scope="module")
def evaluated(spark):
    rows = [tuple(over.get(n, [] if n == "blog_post_dates" else None) for n in P.LINEAGE) for _, over, _ in CASES]
    profiles = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id bigint, {SCHEMA}")
    return {r["id"]: r for r in scoring.evaluate(profiles, str(TODAY)).collect()}


@pytest.mark.parametrize(("i", "rule", "state"), [(i, r, s) for i, (r, _, s) in enumerate(CASES)])
def test_state(evaluated, i, rule, state):
    found = {c["rule_id"]: c for c in evaluated[i]["components"]}
    assert (found[rule]["state"] if rule in found else "declined") == state
    if state == "abstained":
        assert found[rule]["points"] == 0 and found[rule]["reason"]


def test_invariants(evaluated):
    for row in evaluated.values():
        assert row["total"] == sum(c["points"] for c in row["components"])
        assert all((c["state"] == "abstained") == (c["points"] == 0) for c in row["components"])
        assert 0 <= row["upside"] <= 50
        assert row["admitted"] == (row["total"] + row["upside"] >= 55)
        assert row["evaluated_on"] == TODAY


def test_bands(spark):
    got = spark.createDataFrame([(t,) for t in (29, 30, 54, 55, 74, 75)], "t int").select(scoring.band(F.col("t")).alias("b")).collect()
    assert [r["b"] for r in got] == ["D", "C", "C", "B", "B", "A"]


def test_declarations(spark):
    rules = R.registry(F.lit(str(TODAY)).cast("date"))
    R.validate(rules)
    assert len(rules) == 17 and not P.unreachable(R.inputs(rules), {"id", "domain", "legal_form"})
    with pytest.raises(ValueError):
        R.validate([*rules, rules[0]])
    with pytest.raises(ValueError):
        scoring.evaluate(spark.range(1), "")


def test_streaks(spark):
    rows = [("a", r, date(2026, 1, r), r != 1) for r in (1, 2, 3, 4)] + [("b", r, date(2026, 1, r), r != 3) for r in (1, 2, 3, 4, 5)] + [("c", r, date(2026, 1, 1), True) for r in range(9)]
    history = spark.createDataFrame([(1, 1, rule, run, day, hit) for rule, run, day, hit in rows], "company_id int, phase int, rule_id string, run_id int, day date, abstained boolean")
    got = {r["rule_id"]: (r["days"], r["since"]) for r in scoring.abstention_streaks(history).collect()}
    assert got == {"a": (3, date(2026, 1, 2))}
