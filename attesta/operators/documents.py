"""HTML, XML and robots documents: parsed once each by an Arrow function, judged by columns.

``parsed`` reads a page with the standard library's parser into one struct; what a reader wants to know
about the page is then a column expression over the struct, or over the raw page where plain text
search is enough. Unmeasured is null, never zero.
"""

from __future__ import annotations

import gzip
import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from attesta.functions import dates, urls
from attesta.functions.text import let

# Fixed values, in order of precedence: markers of shop systems, carts and trust badges; schema types; words and
# probes of blogs and imprints; phrases and labels of credits; headings and addresses of providers; legal forms.
PLATFORMS = (("JTL", ("jtl-nav-wrapper", "jtl-validate", "jtl_token", "jtlPackFormTranslations")), ("Shopify", ("cdn.shopify.com",)), ("Shopware", ("/bundles/storefront/",)))
WOOCOMMERCE = ("wp-content", "woocommerce")
CART = (
    "/warenkorb", "/cart", "/checkout", "/kasse", "/basket", "add-to-cart", "add_to_cart", "addtocart", "shopping-cart", "shopping_cart", "minicart",
    "mini-cart", "cart-drawer", "data-cart", "in den warenkorb", "zum warenkorb", "in den einkaufswagen", "produkt kaufen", "jetzt kaufen",
)
TRUST = r"(?i)trustedshops|trustbadge"
ARTICLE_TYPES = ("Article", "BlogPosting", "NewsArticle", "TechArticle")
BLOG_WORDS = ("blogs", "blog", "magazin", "ratgeber", "news", "journal", "tipps")
IMPRINT = r"(?i)impressum|imprint|legal-notice"
IMPRINT_PROBES = ("/impressum", "/imprint", "/impressum.html", "/pages/impressum", "/legal/impressum")
CREDIT = r"(?i)realisiert von|umgesetzt von|powered by|webdesign\s*[:by]|programmierung\s*:|gestaltung\s*:|entwickelt von"
CREDIT_LINK = r"(?i)agentur|design|media|digital|webdesign"
PLATFORM_CREDIT = r"(?i)jtl[- ]?shop|shopify|woocommerce|wordpress|shopware|magento|prestashop|gambio|oxid|plentymarkets"
PROVIDER = r"(?iu)Angaben\s+gem[äa]ß\s+§\s*5|Gesetzliche\s+Anbieterkennung|Anbieterkennzeichnung|Verantwortlich\s+f[üu]r\s+den\s+Inhalt|Diensteanbieter|Impressum"
ADDRESS = r"(?U)\b(?:[A-Z]{1,2}-)?\d{4,5}\s+[A-ZÄÖÜ][\wäöüß.-]+"
PROVIDER_CHARS = 400
LEGAL_FORMS = (
    ("GmbH & Co. KGaA", r"GmbH\s*&\s*Co\.?\s*KGaA"),
    ("GmbH & Co. KG", r"GmbH\s*&\s*Co\.?\s*KG"),
    ("AG & Co. KG", r"AG\s*&\s*Co\.?\s*KG"),
    ("UG (haftungsbeschränkt)", r"\bUG\b\s*\(?\s*haftungsbeschr[äa]nkt\s*\)?"),
    ("gGmbH", r"\bgGmbH\b"),
    ("GmbH", r"\bGmbH\b"),
    ("KGaA", r"\bKGaA\b"),
    ("e.Kfr.", r"\be\.\s?Kfr\."),
    ("e.K.", r"\be\.\s?K\.(?!\w)"),
    ("Einzelunternehmen", r"\bEinzelunternehmen\b"),
    ("GbR", r"\bGbR\b|\bGesellschaft b[üu]rgerlichen Rechts\b"),
    ("OHG", r"\bOHG\b|\boHG\b"),
    ("Ltd", r"\b(?:Ltd\.?|LTD\.?|Limited)\b"),
    ("AG", r"\bAG\b"),
    ("KG", r"\bKG\b"),
)
_HIDDEN = ("script", "style", "noscript", "template")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}



def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Types as objects: workers import this module without a session to parse them.
_TEXTS = T.ArrayType(T.StringType())
PAGE = _struct(
    text=T.StringType(),
    description=T.StringType(),
    alternates=T.ArrayType(_struct(code=T.StringType(), href=T.StringType())),
    jsonld=_TEXTS,
    times=_TEXTS,
    links=T.ArrayType(_struct(href=T.StringType(), text=T.StringType(), title=T.StringType(), in_footer=T.BooleanType(), footer=T.IntegerType())),
    footers=_TEXTS,
)


class _Page(HTMLParser):
    """Collects what ``PAGE`` holds in one pass; unclosed elements need no repair for that."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.description = None
        self.alternates, self.jsonld, self.times, self.links = [], [], [], []
        self.hidden = None
        self.footer: list[int] = []  # numbers of the open footers
        self.footers: list[list[str]] = []
        self.script: list[str] | None = None
        self.link: dict | None = None
        self.marked: list[tuple[str, int]] = []  # open elements whose class says footer, and the number of their text
        self.by_class: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in _HIDDEN and self.hidden is None:
            self.hidden = tag
            if tag == "script" and a.get("type", "").lower() == "application/ld+json":
                self.script = []
        elif tag == "meta" and a.get("name", "").lower() == "description" and self.description is None:
            self.description = a.get("content", "").strip()
        elif tag == "link" and "alternate" in a.get("rel", "").lower().split() and "hreflang" in a:
            self.alternates.append({"code": a["hreflang"].strip().lower(), "href": a.get("href", "").strip()})
        elif tag == "time" and "datetime" in a:
            self.times.append(a["datetime"])
        elif tag == "footer":
            self.footer.append(len(self.footers))
            self.footers.append([])
        if tag == "a" and "href" in a:
            self.link = {"href": a["href"], "text": "", "title": a.get("title", ""), "footer": self.footer[-1] if self.footer else None, "by_class": self.marked[-1][1] if self.marked else None}
            self.links.append(self.link)
        if tag not in _VOID:
            if "footer" in a.get("class", "") and tag != "footer":
                self.marked.append((tag, len(self.by_class)))
                self.by_class.append([])
            elif self.marked and self.marked[-1][0] == tag:
                self.marked.append((tag, self.marked[-1][1]))

    def handle_endtag(self, tag):
        if tag == self.hidden:
            if self.script is not None:
                self.jsonld.append("".join(self.script))
            self.hidden = self.script = None
        elif tag == "footer" and self.footer:
            self.footer.pop()
        elif tag == "a":
            self.link = None
        if self.marked and self.marked[-1][0] == tag:
            self.marked.pop()

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        if self.hidden is None:
            self.text.append(data)
            if self.link is not None:
                self.link["text"] += data
            if self.footer:
                self.footers[self.footer[-1]].append(data)
            if self.marked:
                self.by_class[self.marked[-1][1]].append(data)

    def result(self) -> dict:
        footers = self.footers or self.by_class
        for link in self.links:
            by_class = link.pop("by_class")
            link["footer"] = link["footer"] if self.footers else by_class
            link["in_footer"] = link["footer"] is not None
            link["text"] = link["text"].strip()
        return {
            "text": " ".join(" ".join(self.text).split()), "description": self.description, "alternates": self.alternates, "jsonld": self.jsonld, "times": self.times,
            "links": self.links, "footers": [" ".join("".join(f).split()) for f in footers],
        }


def read_page(html: str | None) -> dict:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page.result()


@pandas_udf(PAGE)
def parsed(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(h) for h in html], columns=["text", "description", "alternates", "jsonld", "times", "links", "footers"])


# What the raw page shows.


def platform(html: Column) -> Column:
    """The first shop system with a marker; null says nothing about there being a shop."""
    lowered = F.lower(html)
    found = F.when(F.contains(lowered, F.lit(WOOCOMMERCE[0])) & F.contains(lowered, F.lit(WOOCOMMERCE[1])), "WooCommerce")
    for name, markers in reversed(PLATFORMS):
        hit = F.lit(False)
        for m in markers:
            hit = hit | F.contains(html, F.lit(m))
        found = F.when(hit, F.lit(name)).otherwise(found)
    return found


def cart_marker(html: Column) -> Column:
    lowered = F.lower(html)
    return F.get(F.filter(F.array(*map(F.lit, CART)), lambda m: F.contains(lowered, m)), 0)


def trust_badge(html: Column) -> Column:
    return F.regexp_like(html, F.lit(TRUST))


# What the parsed page shows; ``page`` is the struct of ``parsed``.


def description_length(page: Column) -> Column:
    return F.length(page["description"])


def languages(page: Column) -> Column:
    """Distinct languages of the alternates, null without any."""
    codes = F.filter(F.transform(page["alternates"], lambda a: F.element_at(F.split(a["code"], "-"), 1)), lambda c: (c != "") & (c != "x"))
    return F.nullif(F.size(F.array_distinct(codes)), F.lit(0))


def locale_prefixes(page: Column, site: Column) -> Column:
    """struct<primary, secondary>: path prefixes of the storefronts the page declares on its own site."""
    own = F.filter(page["alternates"], lambda a: (a["code"] != "") & (a["href"] != "") & urls.same_site(a["href"], site))
    named = F.transform(own, lambda a: F.struct(a["code"].alias("code"), F.regexp_replace(urls.path(a["href"]), "/+$", "").alias("prefix")))
    primary = F.coalesce(F.element_at(F.filter(F.concat(F.array(F.struct(F.lit("x-default").alias("code"), F.lit("").alias("prefix"))), named), lambda n: n["code"] == "x-default"), -1)["prefix"], F.lit(""))
    others = F.array_sort(F.array_distinct(F.transform(F.filter(named, lambda n: (n["code"] != "x-default") & (n["prefix"] != "") & (n["prefix"] != primary)), lambda n: n["prefix"])))
    return F.struct(primary.alias("primary"), others.alias("secondary"))


def footer_credit(page: Column, domain: Column) -> Column:
    """An agency named in a footer, footer by footer: the phrase with ten characters before and sixty after, else the
    label of the footer's first outside link that looks like an agency's. Shop systems are no agencies."""
    def phrase(text: Column) -> Column:
        found = F.trim(F.regexp_extract(text, f"(?i)(.{{0,10}}(?:{CREDIT[4:]}).{{0,60}})", 1))
        return let(found, lambda c: F.when((c != "") & ~F.regexp_like(c, F.lit(PLATFORM_CREDIT)), c))

    def label(number: Column) -> Column:
        outside = F.filter(page["links"], lambda link: (link["footer"] == number) & ~F.contains(link["href"], domain) & ~link["href"].rlike("^[/#]"))
        labels = F.transform(outside, lambda link: F.trim(F.regexp_replace(F.concat_ws(" ", link["text"], link["title"]), r"\s+", " ")))
        return F.substring(F.get(F.filter(labels, lambda t: F.regexp_like(t, F.lit(CREDIT_LINK)) & ~F.regexp_like(t, F.lit(PLATFORM_CREDIT))), 0), 1, 70)

    return F.get(F.array_compact(F.transform(page["footers"], lambda text, i: F.coalesce(phrase(text), label(i)))), 0)


def provider_block(text: Column, address: str = ADDRESS, provider: str = PROVIDER) -> Column:
    """The text after the first ``provider`` heading that has a postal ``address`` within its window."""
    def windows(headings: Column, gaps: Column) -> Column:
        # A heading ends where it and all before it, with the gaps between, add up to; a window may run over the next one.
        ends = F.transform(headings, lambda _, i: F.aggregate(F.slice(F.arrays_zip(headings.alias("h"), F.slice(gaps, 1, F.size(headings)).alias("g")), 1, i + 1), F.lit(0), lambda a, z: a + F.length(z["h"]) + F.length(z["g"])))
        return F.transform(ends, lambda e: F.substring(text, e + 1, F.lit(PROVIDER_CHARS)))

    def first(headings: Column) -> Column:
        found = let(F.split(text, provider, -1), lambda gaps: F.get(F.filter(windows(headings, gaps), lambda w: F.regexp_like(w, F.lit(address))), 0))
        return F.when(F.size(headings) > 0, found)

    return let(F.regexp_extract_all(text, F.lit(provider), F.lit(0)), first)


def legal_form(text: Column) -> Column:
    """The first of the legal forms that the provider's block names."""
    def named(block: Column) -> Column:
        found = F.when(block.isNull(), F.lit(None).cast("string"))
        for name, pattern in LEGAL_FORMS:
            found = found.when(block.rlike(pattern), name)
        return found

    return let(provider_block(text), named)


# JSON-LD.


def _documents(blocks) -> list:
    out = []
    for block in blocks if blocks is not None else []:
        text = re.sub(r"^\s*(?://)?\s*<!\[CDATA\[|(?://)?\s*\]\]>\s*$", "", block or "")
        try:
            out.append(json.loads(text))
        except ValueError:
            continue
    return out


def _walk(node, keys=None):
    """All objects in ``node``; with ``keys`` only below these."""
    if isinstance(node, list):
        for item in node:
            yield from _walk(item, keys)
    elif isinstance(node, dict):
        yield node
        for key, value in node.items():
            if keys is None or key in keys:
                yield from _walk(value, keys)


def schema_types(blocks) -> list[str]:
    found = set()
    for node in _walk(_documents(blocks), ("@graph", "mainEntity", "itemListElement")):
        kind = node.get("@type")
        found.update(k for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str))
    return sorted(found)


def _ratings(node):
    """Every rating object: what stands under ``aggregateRating`` anywhere, and objects of that type."""
    for item in _walk(node):
        below = item.get("aggregateRating")
        yield from [r for r in (below, item if item.get("@type") == "AggregateRating" and "aggregateRating" not in item else None) if isinstance(r, dict)]


def review_count(blocks) -> int | None:
    """The greatest positive number of reviews or ratings that any rating states; null where none does."""
    stated = [str(rating.get(name, "")).strip() for text in (blocks if blocks is not None else []) if _is_json(text) for rating in _ratings(json.loads(text)) for name in ("reviewCount", "ratingCount")]
    return max((n for n in (int(s) for s in stated if re.fullmatch(r"\+?[0-9]+", s)) if n > 0), default=None)


def _is_json(text) -> bool:
    try:
        json.loads(text)
    except (TypeError, ValueError):
        return False
    return True


def ld_dates(blocks) -> list[str]:
    keys = ("datePublished", "dateCreated", "dateModified")
    return [v for node in _walk(_documents(blocks)) for k in keys if isinstance(v := node.get(k), str)]


@pandas_udf(_struct(types=_TEXTS, reviews=T.LongType(), dates=_TEXTS))
def jsonld(blocks: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"types": [schema_types(b) for b in blocks], "reviews": pd.array([review_count(b) for b in blocks], "Int64"), "dates": [ld_dates(b) for b in blocks]})


def has_article(types: Column) -> Column:
    return F.arrays_overlap(types, F.array(*map(F.lit, ARTICLE_TYPES)))


def post_dates(page: Column, ld: Column, today: Column) -> Column:
    """Distinct dates up to today in order: JSON-LD and ``<time>``, and only without any of those the visible text's."""
    def good(days: Column) -> Column:
        return F.array_sort(F.array_distinct(F.filter(days, lambda d: d.isNotNull() & (d <= today))))

    def else_of(days: Column, other) -> Column:
        return let(days, lambda found: F.when(F.size(found) > 0, found).otherwise(other()))

    def written() -> Column:
        return else_of(good(F.transform(F.split(page["text"], r" \| "), dates.german_date)), lambda: good(F.array(dates.german_date(page["text"]))))

    return else_of(good(F.transform(F.concat(ld["dates"], page["times"]), dates.iso_date)), written)


def blog_posts(page: Column, blog_path: Column, index_path: Column) -> Column:
    """Distinct links below the blog's path other than its index; null for none."""
    bare = F.transform(page["links"], lambda link: F.regexp_replace(link["href"], r"[#?].*$", ""))
    index = F.regexp_replace(F.coalesce(index_path, F.lit("")), "/+$", "")
    kept = F.filter(bare, lambda h: F.contains(h, blog_path) & ~((index != "") & F.regexp_replace(h, "/+$", "").endswith(index)) & (F.regexp_replace(F.substring(h, F.position(blog_path, h) + F.length(blog_path), F.length(h)), "/", "") != ""))
    return F.nullif(F.size(F.array_distinct(kept)), F.lit(0))


# Sitemaps and robots.

_DTD = re.compile(rb"<!\s*(DOCTYPE|ENTITY)", re.IGNORECASE)


def read_sitemap(url: str, body: bytes | None) -> tuple[str | None, list[str]]:
    """("index" or "urlset", locations); documents with a DTD, and what is no sitemap, give (None, [])."""
    from xml.etree import ElementTree

    data = body or b""
    try:
        if url.endswith(".gz") or data[:2] == b"\x1f\x8b":
            data = gzip.decompress(data)
        if _DTD.search(data):
            return None, []
        root = ElementTree.fromstring(data)
    except (OSError, EOFError, ElementTree.ParseError):
        return None, []
    space, _, name = root.tag.rpartition("}")
    prefix = f"{space}}}" if space else ""
    kind, entry = {"sitemapindex": ("index", "sitemap"), "urlset": ("urlset", "url")}.get(name, (None, ""))
    locations = [loc.text.strip() for item in root.iter(f"{prefix}{entry}") for loc in item.findall(f"{prefix}loc") if loc.text] if kind else []
    return kind, locations


@pandas_udf(_struct(kind=T.StringType(), locations=_TEXTS))
def sitemap(url: pd.Series, body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_sitemap(u or "", b) for u, b in zip(url, body, strict=True)], columns=["kind", "locations"])


def robots_state(status: Column) -> Column:
    """``parsed`` for 200, ``deny`` where the answer is unavailable, else ``unrestricted``."""
    return F.when(status == 200, "parsed").when(status.isNull() | (status == 429) | (status >= 500), "deny").otherwise("unrestricted")


@pandas_udf(_struct(allowed=T.BooleanType(), delay=T.DoubleType(), sitemaps=_TEXTS))
def robots_rules(body: pd.Series, agent: pd.Series, url: pd.Series) -> pd.DataFrame:
    from urllib.robotparser import RobotFileParser

    rows = []
    for text, name, target in zip(body, agent, url, strict=True):
        rules = RobotFileParser()
        rules.parse((text or "").splitlines())
        delay = rules.crawl_delay(name)
        rows.append((rules.can_fetch(name, target), None if delay is None else float(delay), rules.site_maps() or []))
    return pd.DataFrame(rows, columns=["allowed", "delay", "sitemaps"])


def allowed(status: Column, body: Column, agent: Column, url: Column) -> Column:
    state = robots_state(status)
    return F.when(state == "deny", F.lit(False)).when(state == "unrestricted", F.lit(True)).otherwise(robots_rules(F.coalesce(body, F.lit("")), agent, url)["allowed"])
