"""Documents on literal pages: what is read, in which order, and what stays unmeasured."""

from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from attesta.functions import text
from attesta.operators import addresses, extraction, sampling, verification
from attesta.operators import documents as D

TODAY = date(2026, 8, 15)


def page(spark, html, column):
    """``column`` of the parsed page."""
    rows = spark.createDataFrame([(html,)], "html string").withColumn("page", D.parsed(F.col("html"))).withColumn("ld", D.jsonld(F.col("page.jsonld")))
    return rows.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text_", "form"), [
    ("VERANTWORTLICH FÜR DEN INHALT Muster GmbH 53111 Bonn", "GmbH"), ("verantwortlich für den inhalt Muster GmbH 53111 Bonn", "GmbH"), ("ANGABEN GEMÄSS § 5 Muster KG 53111 Bonn", None),
    ("angaben gemäß § 5 Muster GmbH & Co. KG, Weg 1, 53111 Bonn", "GmbH & Co. KG"), ("Impressum Cookie GmbH " + "x " * 250 + "Impressum Muster e.K. 53111 Köln", "e.K."),
    ("Impressum Impressum Muster AG 1010 Wien", "AG"), ("Impressum ohne Anschrift GmbH", None), ("Muster GmbH 53111 Bonn", None), ("", None), ("Impressum " + "y" * 395 + " 53111 Bonn GmbH", None),
])
def test_legal_form(spark, text_, form):
    assert spark.createDataFrame([(text_,)], "t string").select(D.legal_form(F.col("t")).alias("x")).first()["x"] == form


@pytest.mark.parametrize(("html", "credit"), [
    ("<footer><a href='https://studio.de'>Studio Design</a></footer><footer>Umgesetzt von Muster</footer>", "Studio Design"),
    ("<footer>Powered by JTL-Shop</footer><footer>Hallo, realisiert von Agentur X, Bonn</footer>", "Hallo, realisiert von Agentur X, Bonn"),
    ("<footer>Powered by Shopify <a href='https://a.de' title='Media'>Kontor</a></footer>", "Kontor Media"),
    ("<footer><a href='https://own.de/design'>Design</a><a href='/design'>Design</a><a href='#x'>Design</a></footer>", None),
    ("<div class='site-footer'>umgesetzt von B</div>", "umgesetzt von B"), ("<div class='site-footer'>x</div><footer>y</footer><a href='https://z.de'>Design</a>", None), ("umgesetzt von C", None),
    ("<div class='footer-a'><a href='https://q.de'>Webdesign Q</a></div><div class='footer-b'>entwickelt von D</div>", "Webdesign Q"),
])
def test_footer_credit(spark, html, credit):
    assert page(spark, html, D.footer_credit(F.col("page"), F.lit("own.de"))) == credit


def test_visible_text_and_links(spark):
    html = "<p>A<script>x</script> b</p><style>y</style><a href='/x' title='t'> L </a><template>z</template><noscript>n</noscript>"
    assert page(spark, html, F.col("page.text")) == "A b L"
    assert [tuple(link)[:4] for link in page(spark, html, F.col("page.links"))] == [("/x", "L", "t", False)]
    assert page(spark, "<meta name=Description content=' d '><link rel=alternate hreflang=de-DE href=/a><link rel=alternate hreflang=de-at href=/b><link rel=alternate hreflang=x-default href=/>", D.languages(F.col("page"))) == 1
    assert page(spark, "<meta name=Description content=' äö '>", D.description_length(F.col("page"))) == 2
    assert page(spark, "<p>x", D.languages(F.col("page"))) is None


def ld(*blocks):
    return "".join(f"<script type='application/ld+json'>{b if isinstance(b, str) else json.dumps(b)}</script>" for b in blocks)


@pytest.mark.parametrize(("blocks", "n"), [
    ([{"@type": "Product", "aggregateRating": {"reviewCount": "12", "ratingCount": 7}}], 12), ([{"@type": "AggregateRating", "ratingCount": 5}], 5), ([{"a": [{"b": {"aggregateRating": {"ratingCount": 9}}}]}, {"aggregateRating": {"reviewCount": 3}}], 9),
    ([{"aggregateRating": {"reviewCount": 0}}], None), ([{"aggregateRating": "4.5"}], None), (["{broken", {"aggregateRating": {"reviewCount": " 4 "}}], 4), ([{"aggregateRating": [{"@type": "AggregateRating", "reviewCount": 6}]}], 6),
    ([{"@type": "Product", "reviewCount": 8}], None), ([], None), ([{"@type": "AggregateRating", "aggregateRating": {"reviewCount": 2}, "reviewCount": 50}], 2),
])
def test_review_count(spark, blocks, n):
    assert page(spark, ld(*blocks), F.col("ld.reviews")) == n


def test_schema_types(spark):
    html = ld({"@graph": [{"@type": ["Article", "X"]}, {"mainEntity": {"@type": "Product"}}]}, "//<![CDATA[\n{\"@type\": \"Offer\"}\n//]]>", "{broken")
    assert page(spark, html, F.col("ld.types")) == ["Article", "Offer", "Product", "X"]


@pytest.mark.parametrize(("html", "days"), [
    ("<time datetime='2026-01-02T10:00Z'>x</time>" + ld({"datePublished": "2025-12-31", "dateModified": "2099-01-01"}), [date(2025, 12, 31), date(2026, 1, 2)]),
    ("<p>12. März 2024 | 3.4.2025 | 2025-05-06 | 31. Februar 2024 | Nr. 12.5", [date(2024, 3, 12), date(2025, 4, 3), date(2025, 5, 6)]), ("<p>am 1. MAI 2023 und am 2. Mai 2023", [date(2023, 5, 1)]), ("<p>nichts", []),
])
def test_post_dates(spark, html, days):
    assert page(spark, html, D.post_dates(F.col("page"), F.col("ld"), F.lit(TODAY))) == days


def test_frontier_is_a_queue(spark):
    """Children in the order in which documents list them, cut where a queue would be."""
    docs = spark.createDataFrame([("a.de", "https://a.de/i", ["https://a.de/z", "https://a.de/b", "https://b.de/x"]), ("a.de", "https://a.de/z", ["https://a.de/y", "https://a.de/b"]), ("a.de", "https://a.de/b", ["https://a.de/a"])], "site string, url string, children array<string>")
    roots = spark.createDataFrame([("a.de", "https://a.de/i", 1), ("a.de", "https://a.de/r", 0)], "site string, url string, seq int")
    want = ["https://a.de/r", "https://a.de/i", "https://a.de/z", "https://a.de/b", "https://a.de/y", "https://a.de/a"]
    for most in (1, 3, 4, 50):
        assert [r["url"] for r in extraction.frontier(docs, roots, most=most).orderBy("nth").collect()] == want[:most]
    assert extraction.frontier(docs, roots.limit(0)).count() == 0


def test_brands_are_cut_after_the_comparison(spark):
    long = "x" * 90
    rows = spark.createDataFrame([([" A  b ", "a B", "", long, long + "y", long, *map(str, range(9))],)], "n array<string>").select(text.brands(F.col("n")).alias("b")).first()["b"]
    assert rows == ["A b", "x" * 80, "x" * 80, "x" * 80, "0", "1", "2", "3"]


def test_verdict_of_hosts(spark):
    rows = [("ok", "8.8.8.8"), ("ok", "2001:4860:4860::8888"), ("bad4", "8.8.8.8"), ("bad4", "10.0.0.1"), ("bad6", "fe80::1"), ("mapped", "::ffff:127.0.0.1"), ("odd", "256.1.1.1"), ("odd2", "nonsense")]
    got = {r["host"]: r["allowed"] for r in addresses.verdict(spark.createDataFrame(rows, "host string, address string")).collect()}
    assert got == {"ok": True, "bad4": False, "bad6": False, "mapped": False, "odd": True, "odd2": True}


@pytest.mark.parametrize("cut", [0, 2000])
def test_contained(spark, cut):
    """Long, short and very short passages, at edges of words, against plain search."""
    docs = [(1, "Der schnelle braune Fuchs springt  über den faulen Hund"), (2, "ab"), (3, ""), (4, None), (5, "x" * cut + " eins zwei drei vier fünf sechs sieben"), (6, "GROSSE Straße"), (1, "noch ein Text")]
    passages = [(1, "schnelle Braune fuchs springt über den"), (2, "nelle braune Fuchs springt über d"), (3, "a"), (4, "zwei drei"), (5, "strasse"), (6, ""), (7, None), (8, "fehlt ganz und gar in allen Texten"), (9, "ein Text"), (10, "eins zwei drei vier fünf sechs sieben acht")]

    def plain(t):
        return " ".join((t or "").split()).lower().replace("ß", "ss")

    want = {(i, j) for i, d in docs for j, p in passages if d is not None and plain(p) and plain(p) in plain(d)}
    got = verification.contained(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(passages, "item_id int, text string")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_provider_patterns(spark):
    rows = spark.createDataFrame([("Impressum Muster 53111 Bonn a@b.de",), ("a@b.de " * 200 + "Impressum x",), (None,)], "t string").withColumn("b", D.provider_block(F.col("t")))
    got = {r["pattern"]: (r["whole"], r["block"]) for r in verification.presence(rows, F.col("t"), F.col("b"), {"mail": "@", "bonn": "Bonn"}).collect()}
    assert got == {"mail": (2, 1), "bonn": (1, 1)}


def test_permissions(spark):
    wanted = spark.createDataFrame([(1, "https://a.de/x"), (1, "https://a.de/no/x"), (1, "https://b.de/"), (1, "https://c.de/"), (1, "https://d.de/"), (1, "https://e.de/")], "company_id int, url string")
    policies = spark.createDataFrame(
        [(1, "a.de", 200, "User-agent: *\nDisallow: /no"), (1, "b.de", 503, None), (1, "c.de", 404, None), (1, "e.de", 200, "User-agent: *\nCrawl-delay: 60")], "company_id int, authority string, http_status int, body string"
    )
    got = {r["url"]: r["allowed"] for r in extraction.permissions(wanted, policies, "bot").collect()}
    assert got == {"https://a.de/x": True, "https://a.de/no/x": False, "https://b.de/": False, "https://c.de/": True, "https://d.de/": False, "https://e.de/": False}


def test_imprints_and_blogs(spark):
    links = spark.createDataFrame(
        [(1, "a.de", 0, "https://a.de/imprint", "x", False), (1, "a.de", 1, "https://a.de/p", "Impressum", True), (2, "b.de", 0, "https://x.de/impressum", "Impressum", False), (2, "b.de", 1, "https://b.de/legal-notice", "y", False)],
        "company_id int, domain string, position int, url string, text string, in_footer boolean",
    )
    assert {r["company_id"]: r["url"] for r in extraction.imprint_link(links).collect()} == {1: "https://a.de/p", 2: "https://b.de/legal-notice"}
    row = spark.createDataFrame([("https://a.de", None), ("https://b.de", "https://b.de/imprint")], "base string, link string").select(extraction.imprint_candidates(F.col("base"), F.col("link")).alias("c")).collect()
    assert [len(r["c"]) for r in row] == [5, 5] and row[1]["c"][0] == "https://b.de/imprint"
    anchors = spark.createDataFrame([(1, "a.de", "https://blog.a.de/", "Blog"), (1, "a.de", "https://a.de/x/y", "Licht-Ratgeber"), (1, "a.de", "https://a.de/n", "Newsletter"), (2, "b.de", "https://b.de/n", "Newsletter")], "company_id int, domain string, url string, text string")
    assert {r["company_id"]: r["url"] for r in extraction.blog_anchor(anchors).collect()} == {1: "https://blog.a.de/"}
    places = spark.createDataFrame([(["https://a.de/z", "https://a.de/de/ratgeber/x"], ["https://a.de/blog/y"]), ([], ["https://a.de/newsletter"])], "s array<string>, l array<string>")
    assert [r["x"] for r in places.select(sampling.blog_location(F.col("s"), F.col("l"), F.lit("a.de")).alias("x")).collect()] == ["/de/ratgeber", None]


def test_blog_index_and_location(spark):
    rows = [
        (1, "a.de", "/magazin", "https://a.de/magazin/x/y", False), (1, "a.de", "/magazin", "https://a.de/magazin/b", True), (1, "a.de", "/magazin", "https://a.de/magazin/c/", False), (1, "a.de", "/magazin", "https://a.de/magazine", False),
        (2, "b.de", "/blogs", "https://b.de/blogs/", True), (2, "b.de", "/blogs", "https://x.de/blogs", False), (3, "c.de", "/blog", "https://c.de/shop", True),
    ]
    got = sampling.blog_index(spark.createDataFrame(rows, "company_id int, domain string, blog_path string, url string, in_sitemap boolean"))
    assert {r["company_id"]: r["url"] for r in got.collect()} == {1: "https://a.de/magazin/c/", 2: "https://b.de/blogs/"}
    by_path = spark.createDataFrame([(1, "/blog"), (2, None), (3, None)], "company_id int, path string")
    anchors = spark.createDataFrame([(1, "a.de", "https://a.de/x"), (2, "b.de", "https://blog.b.de/"), (3, "c.de", "https://www.c.de/service/ratgeber/"), (4, "d.de", None)], "company_id int, domain string, url string")
    got = {r["company_id"]: (r["path"], r["url"], r["basis"]) for r in sampling.located_blogs(by_path, anchors).collect()}
    assert got == {1: ("/blog", None, "path_vocabulary"), 2: (None, "https://blog.b.de/", "anchor_text"), 3: ("/service/ratgeber", "https://www.c.de/service/ratgeber/", "anchor_text")}


def test_required_paths(spark):
    rows = [
        (1, "a.de", 200, "User-agent: *\nDisallow: /"), (2, "b.de", 200, "User-agent: *\nDisallow: /sitemap.xml"), (3, "c.de", 200, "User-agent: *\n" + "".join(f"Disallow: {p}\n" for p in D.IMPRINT_PROBES)),
        (4, "d.de", 200, "User-agent: *\nDisallow: /impressum.html"), (5, "e.de", 503, None), (6, "f.de", 404, None), (7, "g.de", 200, ""),
    ]
    got = {r["company_id"]: r["reason"] for r in extraction.required_paths(spark.createDataFrame(rows, "company_id int, authority string, http_status int, body string"), "bot").collect()}
    assert got == {1: "robots_disallowed: / is disallowed", 2: "robots_disallowed: /sitemap.xml is disallowed", 3: "robots_disallowed: every imprint path is disallowed"}


def test_discovery(spark):
    answers = [(1, 'Here: {"shops": [{"domain": "https://www.Shop-A.de/x", "name": "A"}, {"domain": "amazon.de"}, "b.at", {"domain": "nonsense"}, {"name": "no domain"}]} sources [1]'), (2, '{"shops": ["shop-a.de", "c.li"]}'), (3, "no answer"), (4, '{"shops": []}'), (5, '{"other": 1}')]
    fresh, report = verification.discovered(spark.createDataFrame(answers, "call int, answer string"), spark.createDataFrame([("b.at",)], "domain string"))
    assert {tuple(r) for r in fresh.collect()} == {("shop-a.de", "A", "DE"), ("c.li", None, None)}
    assert {r["measure"]: r["n"] for r in report.collect()} == {"calls": 5, "unparsed": 2, "unusable": 1, "marketplaces": 1}
