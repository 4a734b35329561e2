"""Searches, archives and classifiers: brute force, round trips, held-out accuracy."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import common, graph, langid, quality, topk, vectors, warc


@pytest.fixture(scope="module")
def embeddings(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(700, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:300] = x[100]  # one very common vector
    rows = [(i, [float(v) for v in x[i]], 1.0) for i in range(700)]
    odd = [(1000, None, 1.0), (1020, [1.0, None], 1.0), (1040, [math.nan, 1.0], 1.0), (1060, [math.inf], 1.0), (None, [1.0], 1.0), (20, [float(v) for v in x[20]], 2.0)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score double").repartition(3), x


def brute_top(x, k=20):
    """Rows of ``x``, of which that of id 20 stands there twice: every row is a candidate of the queries of other ids."""
    rows = [*range(len(x)), 20]
    out = {}
    for q in dict.fromkeys(i for i in rows if i % 20 == 0):
        found = [(i, x[q] @ x[i]) for asked in rows if asked == q for i in rows if i != q]
        out[q] = sorted(found, key=lambda f: (-f[1], f[0]))[:k]
    return out


@pytest.mark.parametrize("shard", [4096, 150])
def test_exact(embeddings, monkeypatch, shard):
    monkeypatch.setattr(vectors, "SHARD", shard)
    df, x = embeddings
    w = np.floor(64 * x.astype(float)).astype(int)
    want = brute_top(w)
    got = {}
    for r in sorted(topk.top(df).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == want


def test_exact_beyond_floats(spark):
    df = spark.createDataFrame([(0, [1e9, 3.0]), (20, [1e9 + 1, 2.0]), (3, [1e9, 4.0]), (4, [1e308, 1.0]), (40, [])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top(df).collect()}
    a, b = 64 * 10**9, 64 * (10**9 + 1)
    assert got[(0, 20)] == min(a * b + 192 * 128, 2**63 - 1) and got[(0, 4)] == 2**63 - 1 and got[(40, 0)] == 0
    small = spark.createDataFrame([(0, [1e6, 3.0]), (20, [1e6, 2.0])], "vec_id long, embedding array<double>")
    assert topk.top(small).where("query_id = 0").first()["score"] == 64_000_000**2 + 192 * 128
    assert topk.top(df.limit(0)).count() == 0 and topk.top(df.where("vec_id = 0")).count() == 0


def test_graph_recall(embeddings, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 400)
    df, x = embeddings
    y = x.astype(float)
    want = brute_top(y)
    got = {}
    for r in sorted(graph.nearest(df).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in rows}) / len({i for i, _ in rows}) for q, rows in want.items())
    assert hits / len(want) >= 0.95
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 21)) and q not in {i for _, i, _ in rows}
        assert all(s == pytest.approx(float(y[q] @ y[i]), abs=1e-12) for _, i, s in rows)
    assert [i for _, i, _ in got[100]] == list(range(101, 121))  # ties to the smaller ids
    assert [i for _, i, _ in got[20]] == [i for i, _ in want[20]]  # rows that repeat a query's id are one query
    assert graph.nearest(df.limit(0)).count() == 0


def test_graph_takes_no_zero_vectors(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [0.5, 0.5]), (5, []), *[(20, [1.0, 0.0])] * 30, *[(6, [1.0, 0.0])] * 25, (7, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in graph.nearest(df).collect())
    assert [r[0] for r in got] == [20] * 20 and {r[2:] for r in got} == {(6, 1.0)}


def test_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 8 * topk.BLOCK)
    n, r = 32 * topk.BLOCK, np.random.default_rng(3)
    near = 0.02 * r.normal(size=(n, 8))
    near[np.arange(n), np.arange(n) // (4 * topk.BLOCK)] += 1  # ids that are close hold alike vectors
    alike = [(i, [float(v) for v in near[i]]) for i in range(n)]
    mixed = [(i, [float(v) for v in row]) for i, row in enumerate(r.normal(size=(n, 64)))]
    # Where ranges begin depends on a sample of the ids: the shares lay about 0.5 and 0.97.
    for rows, most, least in ((alike, 0.75, 0.0), (mixed, 1.0, 0.9)):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        share = topk.pruning(df).agg((F.sum("scored") / F.sum("blocks")).alias("s")).first()["s"]
        assert least <= share <= most
        w = np.floor(64 * np.array([v for _, v in rows]))
        got = {}
        for x in topk.top(df).collect():
            got.setdefault(x["query_id"], {})[x["rank"]] = (x["vec_id"], x["score"])
        for q in range(0, n, 100):
            scores = w[q] @ w.T
            assert [got[q][i] for i in range(1, 21)] == sorted(((i, s) for i, s in enumerate(scores) if i != q), key=lambda p: (-p[1], p[0]))[:20]


def test_bounds_hold():
    r = np.random.default_rng(9)
    docs, asked = np.floor(64 * r.normal(size=(300, 8))), np.floor(64 * r.normal(size=(40, 8)))
    starts = np.arange(0, 300, 32)
    bound = topk.bounds(docs, starts, asked)
    for b, s in enumerate(starts):
        assert (bound[:, b] >= (asked @ docs[s : s + 32].T).max(axis=1)).all()


@pytest.mark.parametrize("kind", ["skip length", "plain", "foreign gzip"])
def test_warc_round_trip(spark, tmp_path, kind):
    import gzip

    big = "ü" * 70_000
    pages = spark.createDataFrame([(3, "https://a.de/", "<a>"), (1, "u\r\nx: y", "<a>"), (5, None, None), (4, "", ""), (7, "z", big), (None, "n", "<a>"), (9, "w", "\r\n\r\nWARC/1.1\r\n\r\n")], "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    path = f"file://{tmp_path}/w"
    warc.archive(pages.repartition(2), path, compress=kind == "skip length")
    if kind == "foreign gzip":  # one member a record, without its length
        for f in list((tmp_path / "w").iterdir()):
            parts = f.read_bytes().split(b"\r\n\r\nWARC/1.1\r\nWARC-Type")
            whole = [(b"" if i == 0 else b"WARC/1.1\r\nWARC-Type") + p + (b"" if i == len(parts) - 1 else b"\r\n\r\n") for i, p in enumerate(parts)]
            f.with_suffix(".warc.gz").write_bytes(b"".join(map(gzip.compress, whole)))
            f.unlink()
    warc.register(spark)
    df = spark.read.format("warc").load(path)
    rows = {r["record_id"]: r for r in df.collect()}
    assert len(rows) == 7
    assert rows["urn:page:1"]["record_type"] == "response" and rows["urn:page:3"]["refers_to"] == "urn:page:1" and rows["urn:page:5"]["refers_to"] == "urn:page:4"
    for key, html in (("urn:page:1", "<a>"), ("urn:page:3", "<a>"), ("urn:page:7", big), ("urn:page:4", "")):
        data = html.encode()
        assert rows[key]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode() and rows[key]["payload_bytes"] == len(data)
    assert bytes(rows["urn:page:7"]["payload"]) == big.encode() and rows["urn:page:3"]["payload"] is None
    some = df.where("record_type = 'revisit' and record_id in ('urn:page:3', 'urn:page:1')")
    assert [r["record_id"] for r in some.collect()] == ["urn:page:3"]
    assert spark.read.format("warc").option("payload", "false").load(path).where("payload is not null").count() == 0
    empty = f"file://{tmp_path}/e"
    warc.archive(pages.limit(0), empty)
    assert spark.read.format("warc").load(empty).count() == 0


def test_warc_urls_stay(spark, tmp_path):
    urls = ["https://x.de/a%20b?q=100%25", "https://x.de/ü", "u\r\nx: y"]
    pages = spark.createDataFrame([(i, u, f"<p>{i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    warc.archive(pages, f"file://{tmp_path}/u")
    warc.register(spark)
    df = spark.read.format("warc").load(f"file://{tmp_path}/u")
    assert {r["target_uri"] for r in df.collect()} == {*urls[:2], "u%0D%0Ax: y"}
    assert [r["record_id"] for r in df.where(F.col("target_uri") == urls[0]).collect()] == ["urn:page:0"]


def test_warc_of_others(spark, tmp_path):
    """A plain file as crawlers write it: records about the archive, requests, blocks without HTTP, missing headers."""
    def record(kind, headers, block):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", *headers, f"Content-Length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nX: " + b"y" * 3000 + b"\r\n\r\n"
    data = [
        record("warcinfo", ["WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/warc-fields"], b"software: x\r\n"),
        record("request", ["WARC-Target-URI: http://a/", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        record("response", ["WARC-Target-URI: http://a/", "Content-Type: application/http; msgtype=response"], http + b"<p>hi"),
        record("metadata", ["Content-Type: application/warc-fields"], b"via: http://b/"),
        record("resource", ["WARC-Target-URI: file:/x", "Content-Type: text/plain", "WARC-Payload-Digest: sha1:ABC"], b"plain"),
        record("response", ["Content-Type: application/http"], b"HTTP/1.1 204 No Content\r\n"),
        record("conversion", [], b""),
    ]
    (tmp_path / "o.warc").write_bytes(data[0] + b"\r\n" + b"".join(data[1:]))
    warc.register(spark)
    rows = spark.read.format("warc").load(f"file://{tmp_path}").collect()
    assert [(r["record_type"], bytes(r["payload"]), r["payload_bytes"]) for r in rows] == [
        ("warcinfo", b"software: x\r\n", 13), ("request", b"", 0), ("response", b"<p>hi", 5), ("metadata", b"via: http://b/", 14), ("resource", b"plain", 5), ("response", b"", 0), ("conversion", b"", 0),
    ]
    assert rows[4]["payload_digest"] == "ABC" and rows[2]["payload_digest"] is None and rows[0]["record_id"] == "urn:uuid:1"


def test_members_are_gzip():
    import gzip

    assert gzip.decompress(warc.member(b"one") + warc.member(b"two")) == b"onetwo"


def test_warc_pushdown_is_taken():
    from pyspark.sql.datasource import EqualTo, GreaterThan
    from pyspark.sql.types import StringType, StructType

    reader = warc.WarcReader({"path": "x"}, StructType().add("record_type", StringType()))
    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))
    assert reader.wanted == {"warc-type": {"revisit"}} and len(rest) == 1


ALPHABETS = {"aa": "abcde ", "bb": "klmno ", "cc": "uvwäö "}


@pytest.fixture(scope="module")
def speech(spark):
    rnd, rows = random.Random(4), []
    for i in range(400):
        lang = rnd.choice(list(ALPHABETS))
        rows.append((i, "".join(rnd.choice(ALPHABETS[lang]) for _ in range(rnd.choice([20, 300, 900]))) + "e", lang))
    rows += [(1000, None, "aa"), (1001, "123 +", "bb"), (1002, "abcabc" * 40_000, None), (None, "klmno", "bb")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(2)).repartition(3), rows


def common_held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_langid(speech, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_STEPS", 120)
    df, rows = speech
    got = {r["doc_id"]: r for r in langid.predict(df, langid.train([t.encode() for i, t, lang in rows[:300] if lang], [lang for _, _, lang in rows[:300]], steps=120)).collect()}
    truth = {i: lang for i, _, lang in rows[300:400]}
    assert sum(got[i]["lang_pred"] == lang for i, lang in truth.items()) >= 97
    assert (got[1000]["lang_pred"], got[1000]["score"]) == ("und", 0.0) == (got[1001]["lang_pred"], got[1001]["score"])
    assert got[1002]["lang_pred"] == "aa" and got[None]["held_out"] is False and 0 <= got[1002]["score"] <= 1
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    often = [lang for lang, _ in collections.Counter(lang for i, _, lang in rows[:400] if not common_held(i)).most_common(2)]
    assert set(langid.fit(df).languages) == set(often)


def test_predictions_against_a_loop(spark):
    """Every byte by itself, both directions in plain loops, windows as the operator cuts them."""
    rnd = random.Random(12)
    net = langid.Network(["aa", "bb", "cc"], seed=3)
    texts = ["".join(rnd.choice("abckloü +1") for _ in range(n)) + "a" for n in (1, 5, 127, 128, 129, 300)]
    p, size = {k: v.astype(float) for k, v in net.p.items()}, net.hidden

    def states(d, codes):
        h, out = np.zeros(size), []
        for c in codes:
            a = p["in" + d][:, c] + p["state" + d] @ h
            z, n = np.clip(a[:size], 0, 1), np.clip(a[size:], -1, 1)
            h = z * h + (1 - z) * n
            out.append(h)
        return out

    rows = [(i, t) for i, t in enumerate(texts)] * 2  # repeated rows
    got = langid.predict(spark.createDataFrame([*rows, (90, "12 +"), (91, None), (92, "")], "doc_id long, text string").repartition(2), net).collect()
    for r in got:
        if r["doc_id"] >= 90:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        codes, total = texts[r["doc_id"]].encode(), np.zeros(3)
        for at in range(0, len(codes), langid.WINDOW):
            part = codes[at : at + langid.WINDOW]
            padded = part + bytes([langid.PAD]) * (langid.WINDOW - len(part))
            forward, backward = states("f", padded), states("b", padded[::-1])[::-1]
            for t in range(len(part)):
                s = np.exp(p["outf"] @ forward[t] + p["outb"] @ backward[t] + p["bias"][:, 0])
                total += s / s.sum()
        assert r["lang_pred"] == net.languages[int(total.argmax())] and r["score"] == pytest.approx(total.max() / len(codes), abs=1e-4)
    assert len(got) == 15


def test_network_gradient():
    net, r = langid.Network(["a", "b", "c"], hidden=4), np.random.default_rng(0)
    x, y = r.integers(0, 256, (9, 7)), np.arange(7) % 3
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        f, b = net.states("f", x), net.states("b", x[::-1])
        return -np.mean([np.log(net.probabilities(f[t], b[8 - t])[y, np.arange(7)]).mean() for t in range(9)])

    for k, g in net.gradient(x, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, losses = net.p[k][at], []
        for e in (1e-3, -1e-3):
            net.p[k][at] = old + e
            losses.append(loss())
        net.p[k][at] = old
        assert g[at] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=1e-3)


def test_quality(spark):
    rnd, docs, labels = random.Random(6), [], []
    words = [a + b + c for a in "bdfg" for b in "aeiou" for c in ("n", "r", "st")]
    for i in range(900):
        good = rnd.random() < 0.7
        docs.append((i, " ".join(rnd.choice(words) for _ in range(60)) + "." if good else " ".join([rnd.choice(words)] * 60)))
        if i % 2:
            labels.append((i, int(good)))
    docs += [(5000, None), (5001, ""), (None, "x y"), *docs[:5]]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    lab = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, quality int")
    net = quality.fit(d, lab)
    got = {r["doc_id"]: r for r in quality.score(d, net).collect()}
    truth = dict(labels)
    held = [i for i in truth if got[i]["held_out"]]
    assert held and sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.97
    assert 0 <= got[5000]["score"] <= 1 and got[5000]["score"] == got[5001]["score"]
    kept = quality.keep(d, net)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    assert quality.score(d.limit(0), net).count() == 0
    again = [r["score"] for r in quality.score(d, net).where("doc_id = 3").collect()]
    assert len(again) == 2 and again[0] == again[1]
    assert quality.fit(d, lab.limit(0)) is None and {r["score"] for r in quality.score(d, None).collect()} == {quality.DEFAULT_PRIOR}


def plain_risk(zp, zu, prior):
    def loss(z):
        return math.log(1 + math.exp(-z))

    called = sum(loss(-z) for z in zu) / len(zu) - prior * sum(loss(-z) for z in zp) / len(zp)
    return prior * sum(map(loss, zp)) / len(zp), called


@pytest.mark.parametrize("shift", [0.0, 4.0])
def test_risk_and_its_slopes(shift):
    """The value against a loop; the slopes against differences of the unbiased risk, or of its negative part upwards."""
    r = np.random.default_rng(2)
    zp, zu, prior = r.normal(size=6) + shift, r.normal(size=9) - shift, 0.6
    value, gp, gu = quality.risk(zp, zu, prior)
    first, called = plain_risk(zp, zu, prior)
    assert value == pytest.approx(first + max(0.0, called)) and (called < 0) == (shift > 0)

    def aim(a, b):
        first, called = plain_risk(a, b, prior)
        return first + called if shift == 0 else -called

    for z, g, at in ((zp, gp, 0), (zu, gu, 1)):
        for i in range(len(z)):
            both = []
            for e in (1e-5, -1e-5):
                moved = [zp.copy(), zu.copy()]
                moved[at][i] += e
                both.append(aim(*moved))
            assert g[i] == pytest.approx((both[0] - both[1]) / 2e-5, abs=1e-6)


def test_gradient_of_the_scorer():
    r = np.random.default_rng(4)
    x, slope = r.normal(size=(5, quality.N_FEATURES)), r.normal(size=5)
    net = quality.Scorer(x.mean(axis=0), x.std(axis=0) + 1e-3)
    for k, g in net.gradient(x, slope).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, both = net.p[k][at], []
        for e in (1e-5, -1e-5):
            net.p[k][at] = old + e
            both.append(float(slope @ net.logits(x)))
        net.p[k][at] = old
        assert g[at] == pytest.approx((both[0] - both[1]) / 2e-5, rel=1e-4)


def test_class_prior():
    r = np.random.default_rng(8)
    good, bad = r.normal(1, 1, (3000, quality.N_FEATURES)), r.normal(-1, 1, (3000, quality.N_FEATURES))
    for share in (0.2, 0.5, 0.8):
        n = int(share * 1500)
        found = quality.class_prior(good[2000:], np.concatenate([good[:n], bad[: 1500 - n]])[r.permutation(1500)])
        assert abs(found - share) < 0.08
    assert quality.class_prior(good[:3], bad) == quality.DEFAULT_PRIOR


def test_held_out(spark):
    got = spark.range(200).select("id", common.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
