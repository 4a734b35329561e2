"""Recorded runs, versioned tables, stored bodies, briefs and paid work on literal rows."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from attesta.operators import batches, jobs, logs, planning, review, scoring
from attesta.operators import profile as P
from attesta.operators import rules as R
from attesta.sources import files, store

NOW = datetime(2026, 8, 15, 12)


def run(spark, root):
    return {r["id"]: (r["stage"], r["finished_at"], r["aborted_reason"]) for r in store.latest(spark, f"{root}/run", jobs.RUN).collect()}


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert store.latest(spark, path, "a int").count() == 0
    assert store.swap(spark.createDataFrame([(1,)], "a int"), path) == 1
    assert store.swap(store.latest(spark, path, "a int").union(spark.createDataFrame([(2,)], "a int")), path) == 2
    (tmp_path / "t" / "v=3").mkdir()  # a write that did not end
    assert sorted(r["a"] for r in store.latest(spark, path, "a int").collect()) == [1, 2]
    assert store.swap(spark.createDataFrame([(5,)], "a int"), path) == 3


def test_bodies(spark, tmp_path):
    rows = spark.createDataFrame([("Ä b.de", "h1", bytearray(b"one")), ("x.de", "h2", bytearray(b"")), ("x.de", "h3", None), ("x.de", "h2", bytearray(b""))], "domain string, content_hash string, body binary")
    for _ in range(2):
        assert sum(r["bytes"] for r in store.put_bodies(rows, f"file://{tmp_path}/b").collect()) == 3
    assert (tmp_path / "b" / "-b.de" / "h1").read_bytes() == b"one" and sorted(p.name for p in (tmp_path / "b").rglob("*") if p.is_file()) == ["h1", "h2"]
    found = files.bodies(spark, f"file://{tmp_path}/b/*")
    want = spark.createDataFrame([("h1", f"file:{tmp_path}/b/-b.de/h1"), ("gone", "file:/nowhere")], "id string, path string")
    assert {r["id"]: r["text"] for r in files.stored(want, found).collect()} == {"h1": "one", "gone": ""}


def test_request_log(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"host":"b","issued_monotonic":2.5}\n\n{"host":"a","issued_monotonic":1.5}\n')
    assert [r["host"] for r in files.request_log(spark, str(tmp_path / "log.json")).collect()] == ["a", "b"]
    (tmp_path / "bad.json").write_text('{"host":"b"}\n')
    with pytest.raises(Exception, match="issued_monotonic"):
        files.request_log(spark, str(tmp_path / "bad.json")).collect()


def test_runs_open_and_close(spark, tmp_path):
    root = str(tmp_path)
    assert jobs.record(spark, root, "one", NOW, lambda run_id: {}) == 1
    with pytest.raises(ValueError, match="broken"):
        jobs.record(spark, root, "two", NOW, lambda run_id: (_ for _ in ()).throw(ValueError("broken " + "x" * 900)))
    found = run(spark, root)
    assert found[1] == ("one", NOW, None) and found[2][:2] == ("two", None) and found[2][2].startswith("ValueError: broken") and len(found[2][2]) == 500


def test_measurements_become_facts(spark, tmp_path):
    root = str(tmp_path)
    pages = spark.createDataFrame([(1, "<meta name=description content=abc><a href='/Warenkorb'>x</a>", "a.de", "https://a.de/"), (2, None, "b.de", "https://b.de/")], "company_id bigint, html string, domain string, url string")
    first = jobs.extract(spark, root, pages, NOW)
    payloads = spark.createDataFrame([(1, '{"lighthouseResult":{"categories":{"performance":{"score":0.5}}}}'), (2, "{}")], "company_id bigint, payload string")
    second = jobs.pagespeed(spark, root, payloads, NOW)
    answers = spark.createDataFrame([(1, 0, "q0", "Try a.de or B", ["B", "A.de", "b"], "m"), (1, 1, "q1", "nothing", [], "m")], "company_id bigint, query_no int, query string, answer string, brands array<string>, model string")
    third = jobs.ai_check(spark, root, answers, spark.createDataFrame([(1, "a.de", "A GmbH")], "id bigint, domain string, legal_name string"), NOW)
    signals = store.latest(spark, f"{root}/signal", jobs.SIGNAL)
    got = {(r["run_id"], r["company_id"], r["key"]): r["value_text"] if r["value_num"] is None else r["value_num"] for r in signals.collect()}
    assert got == {
        (first, 1, "meta.description_length"): 3.0, (first, 1, "i18n.hreflang_count"): 0.0, (first, 1, "reviews.trusted_shops"): 0.0, (first, 1, "shop.cart_absent"): 0.0, (second, 1, "perf.lighthouse_performance"): 50.0,
        (third, 1, "ai.queries_checked"): 2.0, (third, 1, "ai.brand_mentions"): 1.0, (third, 1, "ai.competitors_mentioned"): "B", (third, 1, "ai.query_text"): "q0 | q1", (third, 1, "ai.model_used"): "m", (third, 1, "ai.checked_at"): "2026-08-15",
    }
    companies = spark.createDataFrame([(1, "a.de", None, False), (2, "b.de", "GbR", True)], "id bigint, domain string, legal_form string, excluded boolean")
    profiles = P.profile(companies, signals, store.latest(spark, f"{root}/run", jobs.RUN))
    jobs.score(spark, root, profiles, 2, NOW, R.VERSION)
    (score,) = store.latest(spark, f"{root}/score", jobs.SCORE).collect()
    parts = store.latest(spark, f"{root}/score_component", jobs.COMPONENT).collect()
    assert score["company_id"] == 1 and score["total"] == sum(p["points"] for p in parts) and all(p["reason"] and p["score_id"] == score["id"] for p in parts)
    assert {p["rule_id"] for p in parts} >= {"opp.de_only", "opp.no_blog"}


def test_reconcile_is_idempotent(spark, tmp_path):
    root = str(tmp_path)
    requests = spark.createDataFrame([(1, "a", 7, 3, 70, "https://a/", None), (1, "b", 8, 3, 80, "https://b/", None), (2, "a", 7, 4, 71, "https://c/", None), (2, "z", 9, 4, 90, "https://z/", "expired")], "batch_id int, custom_id string, company_id bigint, run_id bigint, artifact_id bigint, evidence_url string, outcome string")
    items = spark.createDataFrame([(1, "a", "succeeded", 1), (1, "b", "expired", 1), (2, "a", "succeeded", 1), (2, "z", "succeeded", 2), (1, "a", "server_error", 2)], "batch_id int, custom_id string, outcome string, seq int")
    payloads = spark.createDataFrame([(1, "a", "Muster in Bonn", "Muster"), (1, "b", "x", "x"), (2, "a", "Other", "Muster"), (2, "z", "Z", "Z")], "batch_id int, custom_id string, page string, name string")
    for _ in range(2):
        settled = jobs.reconcile(spark, root, requests, items, payloads, {"name": "impressum.legal_name"}, NOW)
        got = sorted((r["run_id"], r["company_id"], r["artifact_id"], r["value_text"], r["confidence"], r["evidence_url"]) for r in store.latest(spark, f"{root}/signal", jobs.SIGNAL).collect())
        assert got == [(3, 7, 70, "Muster", 1.0, "https://a/"), (4, 7, 71, "Muster", 0.0, "https://c/")]
        requests = settled
    assert {(r["batch_id"], r["custom_id"]): r["outcome"] for r in requests.collect()} == {(1, "a"): "succeeded", (1, "b"): "expired", (2, "a"): "succeeded", (2, "z"): "expired"}


@pytest.fixture(scope="module")
def scored(spark):
    over = {1: {"platform": "JTL", "hreflang_count": 0.0, "agency_credit": "Studio"}, 2: {}, 3: {"ai_queries_checked": 2.0, "ai_brand_mentions": 0.0}, 4: {"ai_queries_checked": 2.0, "ai_brand_mentions": 0.0}, 5: {}}
    kinds = {n: "array<date>" if n == "blog_post_dates" else "date" if slot == "value_date" else "double" if slot == "value_num" else "string" for n, (_, slot) in P.LINEAGE.items()}
    rows = [(i, f"s{i}.de", i == 2, *[o.get(n, [] if n == "blog_post_dates" else None) for n in kinds], *(("a | b", "2026-01-01", "m", "X, Y") if i == 4 else (None,) * 4)) for i, o in over.items()]
    schema = "id int, domain string, contact_blocked boolean, " + ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", ai_query_text string, ai_checked_at string, ai_model_used string, ai_competitors_mentioned string"
    return scoring.evaluate(spark.createDataFrame(rows, schema), "2026-08-15").withColumn("total", F.when(F.col("id") != 5, F.col("total")))


def test_briefs(scored):
    got = {r["id"]: (r["brief"], r["refused"]) for r in scoring.brief(scored).collect()}
    assert {i: r for i, (_, r) in got.items()} == {1: None, 2: "contact_blocked", 3: "missing_basis", 4: None, 5: "not_scored"}
    assert all((b is None) == (r is not None) for b, r in got.values())
    assert "- Shopsystem: JTL" in got[1][0] and "- Betreut von: Studio" in got[1][0] and "- opp.no_blog: Nicht bewertbar" in got[1][0] and "AI visibility" not in got[1][0]
    assert 'with m: "a", "b". The brand was not named in 2 of 2 answers. Named instead: X, Y.' in got[4][0]


def test_reasons_and_hook(spark, scored):
    parts = {r["rule_id"]: r["reason"] for r in scoring.component_rows(scored.where("id = 1")).collect()}
    assert parts["qual.ecommerce_platform"] == "Shopsystem: JTL" and parts["opp.de_only"] == "Nur eine Sprache." and all(parts.values())
    assert scored.where("id = 4").select(scoring.hook(F.col("components")).alias("h")).first()["h"] == "In 2 Antworten kommt die Marke nicht vor."
    rows = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (0.0, None)], "m double, c double").select(scoring.visibility(F.col("m"), F.col("c")).alias("v")).collect()
    assert [r["v"] for r in rows] == ["1/2", "—", "—"]


def test_flags_and_erasure(spark):
    flags = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, "a", 3)], "company_id int, reason string, resolved_at int")
    blocking = spark.createDataFrame([("b",)], "reason string")
    got = {r["id"]: (r["needs_review"], r["contact_blocked"], r["open_flags"]) for r in review.derived(spark.createDataFrame([(1,), (2,)], "id int"), flags, blocking).collect()}
    assert got == {1: (True, True, 2), 2: (False, False, 0)}
    tables = {"company": spark.createDataFrame([(1,), (2,)], "id int"), "score": spark.createDataFrame([(10, 1), (20, 2)], "id int, company_id int"), "score_component": spark.createDataFrame([(10, "r"), (10, "q"), (20, "r")], "score_id int, rule_id string")}
    assert {r["table"]: r["rows"] for r in review.residue(tables, 1).collect()} == {"company": 1, "score": 1, "score_component": 2}


def test_paid_work(spark):
    ready = spark.createDataFrame([(1, 10, "abc", "h", None), (2, None, None, None, "no_page")], "company_id int, artifact_id int, sent string, sent_text_sha256 string, skipped string")
    asked = planning.requests(ready, "impressum")
    assert [(r["custom_id"], r["sent_bytes"]) for r in asked.collect()] == [("impressum-1-10", 3)]
    row = planning.batch_row(asked, "p1", F.lit(0.5)).first()
    assert (row["request_count"], row["est_cost_usd"], [r["custom_id"] for r in row["requests"]]) == (1, 0.5, ["impressum-1-10"])
    cost = spark.range(1).select(planning.reservation(F.lit(10), 2, 1000, 500, F.lit(1.0), F.lit(5.0)).alias("c")).first()["c"]
    assert cost == pytest.approx(10 * (0.001 + 0.0025 + 0.02))
    places = spark.createDataFrame([('{"places":[{"displayName":{"text":"A"},"websiteUri":"https://a.de","formattedAddress":"x"},{"displayName":{"text":"B"}}]}',), ("{}",)], "p string").select(planning.places(F.col("p")).alias("x")).collect()
    assert [tuple(p) for p in places[0]["x"]] == [("A", "https://a.de", "x"), ("B", None, None)] and places[1]["x"] is None
    kinds = spark.createDataFrame([(200, None), (400, "billing_error"), (429, None), (500, None), (404, "x")], "s int, k string").select(batches.outcome_of(F.col("s"), F.col("k")).alias("o")).collect()
    assert [r["o"] for r in kinds] == ["succeeded", "balance_exhausted", "rate_limited", "server_error", "invalid_request"]
    with pytest.raises(Exception, match="403"):
        spark.createDataFrame([(403, None)], "s int, k string").select(batches.outcome_of(F.col("s"), F.col("k"))).collect()


def test_log_verdict(spark):
    spaced = spark.createDataFrame([("a", True), ("b", True)], "host string, kept boolean")
    flight, none = spark.createDataFrame([(2,)], "max_in_flight int"), spark.createDataFrame([], "x int")
    assert logs.verdict(spaced, flight, none).first()["ok"] and not logs.verdict(spaced.limit(0), flight, none).first()["ok"]
    assert not logs.verdict(spaced, spark.createDataFrame([(3,)], "max_in_flight int"), none).first()["ok"] and not logs.verdict(spaced, flight, spark.createDataFrame([(1,)], "x int")).first()["ok"]


def test_places_search(spark):
    pages = {None: '{"places":[{"displayName":{"text":"A"},"websiteUri":"https://www.a.com/","formattedAddress":"Weg 1, 53111 Bonn, Deutschland"},{"displayName":{"text":"N"}}],"nextPageToken":"t"}', "t": '{"places":[{"displayName":{"text":"A2"},"websiteUri":"http://a.com/x"},{"displayName":{"text":"B"},"websiteUri":"b.at"},{"websiteUri":"localhost"}]}'}
    assert planning.paged(pages.__getitem__) == ([pages[None], pages["t"]], 2, False) and planning.paged(pages.__getitem__, most=1)[1:] == (1, True)
    rows = spark.createDataFrame(list(enumerate(planning.paged(pages.__getitem__)[0])), "page int, payload string")
    fresh, report = planning.found_places(rows, spark.createDataFrame([("x.de",)], "domain string"), F.lit("CH"))
    assert {tuple(r) for r in fresh.collect()} == {("a.com", "A", "Bonn", "53111", "DE"), ("b.at", "B", None, None, "AT")}
    assert tuple(report.first()) == (1, 1)
