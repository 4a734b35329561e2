"""Logs, batches, ledgers, review state, writes and streams on literal rows."""

from __future__ import annotations

from datetime import datetime

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from attesta.operators import batches, extraction, ledger, logs, planning, review, sampling, snapshots, verification, writes
from attesta.schema import violations
from attesta.sources import files
from attesta.streaming import monitors


def log(spark, rows):
    return spark.createDataFrame(rows, "host string, issued double, elapsed double")


def test_spacing(spark):
    rows = [("one", 0.0, 0.1), ("ok", 0.0, 0.1), ("ok", 0.99, 0.1), ("bad", 0.0, 0.1), ("bad", 0.97, 0.1)]
    got = {r["host"]: (r["requests"], r["kept"]) for r in logs.spacing(log(spark, rows)).collect()}
    assert got == {"one": (1, True), "ok": (2, True), "bad": (2, False)}


@pytest.mark.parametrize(("rows", "want"), [
    ([("a", 0.0, 5.0), ("b", 1.0, 5.0), ("c", 2.0, 5.0)], 3), ([("a", 0.0, 5.0), ("a", 1.0, 5.0)], 1), ([("a", 0.0, 1.0), ("b", 1.0, 1.0)], 1), ([("a", 0.0, 0.0), ("b", 5.0, 1.0)], 1), ([], 0),
    ([("a", 86_399.0, 5.0), ("b", 86_400.0, 5.0)], 2),
])
def test_in_flight(spark, rows, want):
    assert logs.most_in_flight(log(spark, rows)).first()["max_in_flight"] == want


def test_batch_status(spark):
    outcomes = {1: [], 2: ["succeeded", "balance_exhausted"], 3: ["succeeded"], 4: ["succeeded", "expired"], 5: ["server_error", "succeeded"], 6: ["succeeded", "succeeded"]}
    expected = spark.createDataFrame([(b, str(i)) for b in outcomes for i in range(2)], "batch_id int, custom_id string")
    back = spark.createDataFrame([(b, str(i), o) for b, os in outcomes.items() for i, o in enumerate(os)], "batch_id int, custom_id string, outcome string")
    got = {r["batch_id"]: r["status"] for r in batches.status(expected, back).collect()}
    assert got == {1: "submitted", 2: "balance_exhausted", 3: "completed", 4: "expired", 5: "failed", 6: "reconciled"}
    with pytest.raises((PySparkException, Py4JError)):
        batches.checked(back.union(back)).collect()
    assert {r["outcome"] for r in batches.resubmittable(back).collect()} == {"expired", "server_error"}


def test_ledger(spark):
    now = F.lit("2026-03-31 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([(datetime(2026, 3, 1, 0, 14), 1.0), (datetime(2026, 3, 1, 0, 0), 4.0), (datetime(2026, 3, 30), 2.0)], "at timestamp, amount double")
    assert ledger.spent(rows, now).first()["spent"] == 3.0
    assert ledger.spent(rows.limit(0), now).first()["spent"] == 0.0
    with pytest.raises((PySparkException, Py4JError)):
        prices = spark.createDataFrame([("m", True, 1.0, 2.0)], "model string, batch boolean, input_per_mtok double, output_per_mtok double")
        ledger.priced(spark.createDataFrame([("x", True, 1, 1, 0)], "model string, batch boolean, input_tokens int, output_tokens int, searches int"), prices).collect()
    with pytest.raises((PySparkException, Py4JError)):
        ledger.run_totals(spark.createDataFrame([(1, -3.0)], "run_id int, amount double")).collect()


def test_review(spark):
    flags = spark.createDataFrame([(1, "a", 1, False), (1, "a", 2, True), (2, "b", 1, False)], "company_id int, reason string, at int, resolves boolean")
    state = review.flag_state(flags)
    assert {(r["company_id"], r["resolved_at"]) for r in state.collect()} == {(1, 2), (2, None)}
    wanted = spark.createDataFrame([(1, "a"), (2, "c"), (2, "c")], "company_id int, reason string")
    assert [tuple(r) for r in review.to_raise(wanted, state).collect()] == [(2, "c")]
    claims = spark.createDataFrame([("h", 1, False), ("h", 5, True), ("g", 4, False), ("g", 3, False)], "host string, company_id int, seeded boolean")
    assert {r["host"]: r["owner"] for r in review.site_owner(claims).collect()} == {"h": 5, "g": 3}
    companies = spark.createDataFrame([(1, "a.de", "b.de"), (2, "b.de", None)], "id int, domain string, site_domain string")
    assert {(r["id"], r["rival"]) for r in review.rivals(companies).collect()} == {(1, 2), (2, 1)}


def test_checks(spark):
    rows = spark.createDataFrame([(1, 3, "A", None), (2, 1, "A", datetime(2026, 1, 1).date())], "id int, phase int, band string, evaluated_on date")
    assert {(r["id"], r["check"]) for r in violations("score", rows).collect()} == {(1, "phase"), (1, "evaluated_on")}


def test_snapshots(spark):
    a = spark.createDataFrame([("k", "x"), ("k", "a"), ("k", "x"), ("gone", "1"), ("same", "s")], "key string, value string")
    b = spark.createDataFrame([("k", "x"), ("new", "2"), ("same", "s")], "key string, value string")
    got = {r["key"]: (r["before"], r["after"], r["change"]) for r in snapshots.diff(snapshots.snapshot(a, ["key"]), snapshots.snapshot(b, ["key"]), ["key"]).collect()}
    assert got == {"k": ("a; x", "x", "changed"), "gone": ("1", None, "disappeared"), "new": (None, "2", "appeared")}


def test_writes(spark):
    old = spark.createDataFrame([(1, None), (2, "x")], "id int, name string")
    new = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "id int, name string, confidence double")
    assert sorted(map(tuple, writes.fill_if_null(old, new, ["id"], ["name"]).collect())) == [(1, "a"), (2, "x")]
    role = spark.createDataFrame([("m", None)], "name string, role string")
    assert writes.insert_not_exists(role, spark.createDataFrame([("m", None), ("m", "r")], "name string, role string"), ["name", "role"]).count() == 2


def test_seeds_and_logs(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿domain,legal_name,country\nhttps://WWW.Example.de/shop,A,de\n# note,,\n\nexample.de,B,\nmüller.at,C,AT\n", encoding="utf-8")
    got = {r["domain"]: (r["legal_name"], r["country"]) for r in files.seeds(spark, str(tmp_path / "s.csv")).collect()}
    assert got == {"example.de": ("A", "DE"), "xn--mller-kva.at": ("C", "AT")}
    (tmp_path / "bad.csv").write_text("domain,country\nexample.de,FR\n")
    with pytest.raises((PySparkException, Py4JError)):
        files.seeds(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "log.json").write_text('{"host":"a","issued_monotonic":1.5}\n\n{"host":\n')
    with pytest.raises((PySparkException, Py4JError)):
        files.request_log(spark, str(tmp_path / "log.json")).collect()
    assert spark.sql("select X'ff41' as b").select(files.decoded(F.col("b")).alias("t")).first()["t"] == "�A"


def test_frontier_and_shards(spark):
    docs = spark.createDataFrame([("a.de", "https://a.de/i", ["https://a.de/1", "https://b.de/x", "https://a.de/i"]), ("a.de", "https://a.de/1", ["https://a.de/2"])], "site string, url string, children array<string>")
    roots = spark.createDataFrame([("a.de", "https://a.de/i")], "site string, url string")
    assert [(r["url"], r["nth"]) for r in extraction.frontier(docs, roots).orderBy("nth").collect()] == [("https://a.de/i", 1), ("https://a.de/1", 2), ("https://a.de/2", 3)]
    shards = spark.createDataFrame([("s", "https://s/articles.xml", u) for u in "abc"] + [("s", "https://s/blog.xml", u) for u in "ab"] + [("s", "https://s/products.xml", "z")], "site string, shard string, url string")
    assert {r["shard"][10:]: r["kind"] for r in sampling.shard_kinds_by_content(shards).collect()} == {"articles.xml": "blog", "blog.xml": "blog", "products.xml": "product"}


def test_payloads(spark):
    rows = spark.createDataFrame([('{"lighthouseResult":{"categories":{"performance":{"score":0.125}}}}',), ('{"lighthouseResult":{"runtimeError":{"code":"NO_FCP"}}}',), ('{"lighthouseResult":{"categories":{"performance":{"score":1.5}}}}',)], "p string")
    assert [tuple(r["x"]) for r in rows.select(planning.lighthouse(F.col("p")).alias("x")).collect()] == [(12.0, None), (None, "NO_FCP"), (None, "score out of range")]
    address = spark.createDataFrame([("Weg 1, 53111 Bonn, Deutschland",), ("Nowhere",)], "a string").select(verification.address_parts(F.col("a")).alias("x")).collect()
    assert [tuple(r["x"]) for r in address] == [("53111", "Bonn", "DE"), (None, None, None)]
    answers = spark.createDataFrame([('{"shops":["a.de","b.de"]}',), ('{"shops":[{"domain":"c.de"}]}',), ('{"shops":[]}',), ("nonsense",)], "a string").select(verification.shops(F.col("a")).alias("x")).collect()
    assert [r["x"] for r in answers] == [["a.de", "b.de"], ["c.de"], [], None]


def test_streams(spark, tmp_path):
    rows = [("1", datetime(2026, 1, 1, 0, m), float(m * 60)) for m in (0, 1, 9)] + [("2", datetime(2026, 1, 1), 5.0)]
    spark.createDataFrame(rows, "host string, at timestamp, issued double").selectExpr("cast(host as bigint) as host", "at", "issued").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("host bigint, at timestamp, issued double").parquet(f"{tmp_path}/in")
    q = monitors.requests_by_window(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["start"].minute, r["host"]): r["requests"] for r in spark.table("windows").collect()} == {(0, 1): 2, (5, 1): 1, (0, 2): 1}
    q = monitors.spacing(stream.select("host", "issued")).writeStream.format("memory").queryName("gaps").outputMode("update").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert {r["host"]: (r["requests"], r["min_gap"]) for r in spark.table("gaps").collect()} == {1: (3, 60.0), 2: (1, None)}
