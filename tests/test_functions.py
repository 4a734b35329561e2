from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from attesta.functions import dates, text, urls
from attesta.operators import addresses, documents, sampling, verification


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    rows = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return rows.select(expr(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "want"), [
    ("https://WWW.Example.de/shop", "example.de"), ("example.de.", "example.de"), ("müller.de", "xn--mller-kva.de"), ("localhost", None), ("", None), ("http://user:pw@shop.at:8080/x?y#z", "shop.at"),
])
def test_domain(spark, value, want):
    assert one(spark, urls.normalised_domain, value) == want


@pytest.mark.parametrize(("base", "href", "want"), [
    ("https://a.de/x/", "../y#z", "https://a.de/y"), ("https://a.de", "mailto:x@y.z", None), ("https://a.de", "#top", None), ("https://a.de", "https://b.de", "https://b.de/"), ("https://a.de", "ftp://b.de/x", None),
])
def test_absolute(spark, base, href, want):
    assert one(spark, urls.absolute, base, href) == want


def test_url_parts(spark):
    u = "https://u@www.Shop.de:443/a/b/?q=1#f"
    assert one(spark, urls.authority, u) == "www.shop.de:443" and one(spark, urls.host, u) == "shop.de" and one(spark, urls.origin, u) == "https://www.shop.de:443"
    assert one(spark, urls.path, u) == "/a/b/" and one(spark, urls.has_query, u) and one(spark, urls.path, "https://a.de") == "/"
    assert one(spark, urls.country, "x.li") is None and one(spark, lambda d: urls.country(d, F.lit("AT")), "x.com") == "AT" and one(spark, urls.country, "x.ch") == "CH"


@pytest.mark.parametrize(("value", "want"), [
    ("am 12. März 2023 und 2020-01-01", date(2023, 3, 12)), ("3.4.2021", date(2021, 4, 3)), ("2026-05-29T10:56:32+0200", date(2026, 5, 29)), ("31. Februar 2023, 2020-01-01", None), ("2023-13-01", None), ("nichts", None),
    ("1. Jan. 2022", date(2022, 1, 1)),
])
def test_german_date(spark, value, want):
    assert one(spark, dates.german_date, value) == want


def test_text(spark):
    assert one(spark, text.normalised, "  Große  STRASSE\n") == "grosse strasse"
    assert one(spark, text.verified, "Muster GmbH", "bei  muster\tgmbh, Bonn") is True
    assert one(spark, text.verified_boolean, "true", "", "x") is None
    cut = one(spark, lambda c: text.capped(c, 20), "ä" * 30)
    assert len(cut.encode()) <= 20 and cut.endswith(text.CAP_MARK)
    assert one(spark, text.json_object, 'so: {"a": {"b": 1}} and {more') == '{"a": {"b": 1}}'
    assert one(spark, text.json_object, "none") is None
    assert one(spark, text.category_term, "ab| Zahnbürsten |x") == "Zahnbürsten"
    assert one(spark, lambda c: text.brands(F.split(c, ",")), "Nivea, nivea ,  Dr.  Best,") == ["Nivea", "Dr. Best"]
    assert one(spark, lambda a, b: text.mentioned(a, F.array(b)), "Empfohlen: smile store!", "smile-store") is True
    assert one(spark, text.parsed_custom_id, "impressum-12-7").asDict() == {"kind": "impressum", "company_id": 12, "artifact_id": 7}
    assert one(spark, lambda c: text.rendered(F.lit(3.0), c, F.lit(None).cast("date")), "sitemap") == "3 (sitemap)"


def test_addresses(spark):
    for a, want in (("10.1.2.3", "private"), ("8.8.8.8", None), ("169.254.169.254", "link-local (cloud metadata)"), ("300.1.1.1", None)):
        assert one(spark, addresses.refused_v4, a) == want and one(spark, addresses.refused, a) == want
    assert one(spark, addresses.refused, "::ffff:127.0.0.1") == "loopback"


def test_sampling(spark):
    def candidate(url, trusted=False):
        return one(spark, lambda u: sampling.product_candidate(u, F.lit("a.de"), F.lit("/blog"), trusted), url)

    assert candidate("https://a.de/products/x") and not candidate("https://a.de/products/") and not candidate("https://a.de/products/x?v=1")
    assert not candidate("https://a.de/collections/products/x") and not candidate("https://a.de/blog/products/x") and not candidate("https://b.de/products/x")
    assert candidate("https://a.de/schallzahnbuerste/", True) and not candidate("https://a.de/de-at", True)
    assert one(spark, sampling.shard_kind, "https://a.de/sitemap_products_1.xml") == "product" and one(spark, sampling.shard_kind, "https://a.de/articles-0-sitemap.xml") is None
    assert one(spark, verification.marketplace, "www.amazon.de") and not one(spark, verification.marketplace, "shop-amazon.de")


PAGE = """<html><head><meta name="description" content=" Seife "><link rel="alternate" hreflang="de-DE" href="https://a.de/de/"><link rel="alternate" hreflang="de-AT" href="https://a.de/at/">
<link rel="alternate" hreflang="x-default" href="https://a.de/de"><script type="application/ld+json">//<![CDATA[
{"@graph":[{"@type":["Product","X"],"aggregateRating":{"reviewCount":"12"}},{"@type":"BlogPosting","datePublished":"2026-05-29T10:00:00Z"}]}
//]]></script><script type="application/ld+json">{broken</script></head><body><p>Hallo<p>Welt <time datetime="2027-01-01">x</time><script>var a="</p>";</script>
Impressum Menü. Impressum Angaben: Muster GmbH &amp; Co. KG, 53111 Bonn <a href="/blog/eins?x=1">Eins</a><a href="/blog/">Blog</a>
<footer>Umgesetzt von Agentur Nord <a href="https://nord.de">Nord Digital</a></footer></body></html>"""


def test_documents(spark):
    page = spark.createDataFrame([(PAGE,)], "html string").select("html", documents.parsed(F.col("html")).alias("p")).select("*", documents.jsonld(F.col("p.jsonld")).alias("ld"))
    p, ld, today = F.col("p"), F.col("ld"), F.lit("2026-08-15").cast("date")
    r = page.select(
        documents.description_length(p).alias("d"), documents.languages(p).alias("l"), documents.locale_prefixes(p, F.lit("a.de")).alias("lp"), documents.has_article(ld["types"]).alias("art"),
        F.array_contains(ld["types"], "Product").alias("prod"), documents.post_dates(p, ld, today).alias("dates"), documents.legal_form(p["text"]).alias("form"), documents.footer_credit(p, F.lit("a.de")).alias("credit"),
        documents.blog_posts(p, F.lit("/blog"), F.lit("/blog")).alias("posts"), p["text"].alias("text"),
    ).first()
    assert (r["d"], r["l"], r["art"], r["prod"]) == (5, 1, True, True)
    assert (r["lp"]["primary"], r["lp"]["secondary"]) == ("/de", ["/at"])
    assert r["dates"] == [date(2026, 5, 29)] and r["form"] == "GmbH & Co. KG" and r["posts"] == 1
    assert r["credit"].startswith("Umgesetzt von Agentur Nord") and "var a" not in r["text"] and "Hallo" in r["text"]
    assert documents.review_count(['{"@type":"AggregateRating","ratingCount":3,"x":{"aggregateRating":{"reviewCount":9}}}']) == 9 and documents.review_count([]) is None


def test_markers(spark):
    assert one(spark, documents.platform, "jtl_token shopware") == "JTL" and one(spark, documents.platform, "wp-content WooCommerce") == "WooCommerce" and one(spark, documents.platform, "shopware") is None
    assert one(spark, documents.cart_marker, "<a href=/Kasse>") == "/kasse" and one(spark, documents.cart_marker, "x") is None


def test_sitemaps_and_robots(spark):
    import gzip

    body = b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:i="http://www.google.com/schemas/sitemap-image/1.1"><url><loc> https://a.de/1 </loc><i:image><i:loc>no</i:loc></i:image></url></urlset>'
    assert documents.read_sitemap("s.xml", body) == ("urlset", ["https://a.de/1"]) == documents.read_sitemap("s.xml.gz", gzip.compress(body))
    assert documents.read_sitemap("s.xml", b"<!DOCTYPE x><urlset/>") == (None, []) and documents.read_sitemap("s.xml", b"<html>") == (None, [])
    rules = "User-agent: *\nDisallow: /private\nCrawl-delay: 3\nSitemap: https://a.de/s.xml"
    rows = spark.createDataFrame([(200, rules, "https://a.de/private/x"), (200, rules, "https://a.de/x"), (404, None, "https://a.de/x"), (503, None, "https://a.de/x"), (None, None, "https://a.de/x")], "s int, b string, u string")
    assert [r["x"] for r in rows.select(documents.allowed(F.col("s"), F.col("b"), F.lit("bot"), F.col("u")).alias("x")).collect()] == [False, True, True, False, False]
