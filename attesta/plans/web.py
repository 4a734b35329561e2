"""URLs, page markers, samples and parsed documents over the page table."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import urls
from attesta.operators import documents, review, sampling, writes
from attesta.plans.registry import query, table

_AUTH = "lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#]*)', 1))"
_HOST = f"regexp_replace(regexp_replace({_AUTH}, ':[0-9]*$', ''), '^www\\.', '')"
_PATH = "coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/')"
_SITE = f"regexp_extract({_HOST}, '([^.]+\\.[^.]+)$', 1)"
_PAGE = f"page as (select page_id, url, html, {_AUTH} as authority, {_HOST} as host, {_PATH} as path, {_SITE} as site from pages)"


def _pages(spark, d):
    host = urls.host(F.col("url"))
    return table(spark, d, "pages").select(
        "page_id", "url", "html", urls.authority(F.col("url")).alias("authority"), host.alias("host"), urls.path(F.col("url")).alias("path"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("site")
    )


@query("url_parts", f"with {_PAGE} select page_id, authority, host, path, regexp_matches(url, '^[^?#]*\\?[^#]+') as has_query, len(list_filter(string_split(path, '/'), lambda s: s <> ''))::integer as segments, len(regexp_replace(regexp_replace(path, '/+$', ''), '[^/]', '', 'g'))::integer as depth from page")
def url_parts(spark, d):
    p = _pages(spark, d)
    return p.select("page_id", "authority", "host", "path", urls.has_query(F.col("url")).alias("has_query"), urls.segment_depth(F.col("path")).alias("segments"), urls.slash_depth(F.col("path")).alias("depth"))


@query("same_site", f"with {_PAGE}, s as (select distinct site from page) select p.page_id, s.site, p.host = s.site or ends_with(p.host, '.' || s.site) as same from page p join s on p.site = s.site")
def same_site(spark, d):
    p = _pages(spark, d)
    sites = p.select("site").distinct()
    return p.join(sites, "site").select("page_id", "site", urls.same_site(F.col("url"), F.col("site")).alias("same"))


@query("tld_country", f"with {_PAGE} select page_id, case regexp_extract(host, '([^.]+)$', 1) when 'de' then 'DE' when 'at' then 'AT' when 'ch' then 'CH' when 'lu' then 'LU' when 'li' then null else case when page_id % 2 = 0 then 'AT' end end as country from page")
def tld_country(spark, d):
    return _pages(spark, d).select("page_id", urls.country(F.col("host"), F.when(F.col("page_id") % 2 == 0, "AT")).alias("country"))


# The pages' paths hold no shop patterns; their own first segments stand in for them.
_SHOP = "shop as (select page_id, site, 'https://' || site || case page_id % 6 when 0 then '/products' when 1 then '/products/p' || page_id when 2 then '/en/detail/p' || page_id || '/' when 3 then '/collections/products/x' when 4 then '/blog/produkt/' || page_id else '/de-at' end || case when page_id % 11 = 0 then '?v=1' else '' end as url, page_id % 4 = 0 as trusted from page)"
_LOW = "lower(regexp_extract(url, '^https://[^/?#]*([^?#]*)', 1))"
_CAND = (
    f"not regexp_matches(url, '\\?') and not regexp_matches({_LOW}, '/kategorie/|/collections/|/c/|/categories/') and not starts_with({_LOW}, '/blog/') and"
    f" case when trusted then not (regexp_replace({_LOW}, '/+$', '') = '' or regexp_matches(regexp_replace({_LOW}, '/+$', ''), '^/[a-z][a-z](-[a-z][a-z])?$')) else regexp_matches(regexp_replace({_LOW}, '/+$', ''), '(/detail/|/products/|/produkt/).') end"
)


def _shop(spark, d):
    p = _pages(spark, d)
    n = F.col("page_id").cast("string")
    forms = [F.lit("/products"), F.concat(F.lit("/products/p"), n), F.concat(F.lit("/en/detail/p"), n, F.lit("/")), F.lit("/collections/products/x"), F.concat(F.lit("/blog/produkt/"), n), F.lit("/de-at")]
    url = F.concat(F.lit("https://"), F.col("site"), F.element_at(F.array(*forms), (F.col("page_id") % 6 + 1).cast("int")), F.when(F.col("page_id") % 11 == 0, "?v=1").otherwise(""))
    return p.select("page_id", "site", url.alias("url"), (F.col("page_id") % 4 == 0).alias("trusted"))


@query("product_candidate", f"with {_PAGE}, {_SHOP} select page_id, url, {_CAND} as candidate from shop")
def product_candidate(spark, d):
    return _shop(spark, d).select("page_id", "url", sampling.product_candidate(F.col("url"), F.col("site"), F.lit("/blog"), F.col("trusted")).alias("candidate"))


@query(
    "tiered_min_sample",
    f"with {_PAGE}, {_SHOP}, c as (select site, url, case when trusted then 1 else 2 end as rank from shop where {_CAND}), b as (select site, min(rank) as rank from c group by site)"
    " select c.site, case b.rank when 1 then 'sitemap' else 'pattern' end as tier, min(c.url) as url from c join b on c.site = b.site and c.rank = b.rank group by c.site, b.rank",
)
def tiered_min_sample(spark, d):
    s = _shop(spark, d).where(sampling.product_candidate(F.col("url"), F.col("site"), F.lit("/blog"), F.col("trusted")))
    return sampling.tiered(s.withColumn("tier", F.when(F.col("trusted"), "sitemap").otherwise("pattern")), ["site"])


@query(
    "locale_filtered_count",
    f"with {_PAGE}, {_SHOP}, e as (select site, 'shard' || page_id % 3 as shard, page_id as seq, url, regexp_matches({_LOW}, '^/(en|de-at)(/|$)') as secondary from shop),"
    " once as (select site, url, arg_max(shard, seq) as shard, bool_and(secondary) as secondary from e group by site, url), s as (select site, shard, sum(case when secondary then 0 else 1 end) as own, count(*) as every from once group by all),"
    " n as (select *, case when sum(own) over (partition by site) > 0 then own else every end as n, sum(own) over (partition by site) > 0 and sum(own) over (partition by site) < sum(every) over (partition by site) as filtered from s)"
    " select site, sum(n)::bigint as products, arg_min(shard, (-n, shard)) as top_shard, bool_or(filtered) as filtered from n where n > 0 group by site",
)
def locale_filtered_count(spark, d):
    s = _shop(spark, d)
    second = sampling.secondary_locale(F.col("url"), F.lit(""), F.array(F.lit("/en")))
    entries = s.select("site", F.concat(F.lit("shard"), (F.col("page_id") % 3).cast("string")).alias("shard"), F.col("page_id").alias("seq"), "url", second.alias("secondary"))
    return sampling.catalogue(entries)


@query("duplicate_owner", f"with {_PAGE} select host, coalesce(min(case when page_id % 3 = 0 then page_id end), min(page_id)) as owner, count(*)::bigint as claims from page group by host")
def duplicate_owner(spark, d):
    return review.site_owner(_pages(spark, d).select("host", F.col("page_id").alias("company_id"), (F.col("page_id") % 3 == 0).alias("seeded")))


_FETCH = "fetched as (select doc_id % 40 as company_id, lang as kind, source as url, sha256(text) as content_hash, doc_id as seq, case when doc_id % 9 = 0 then 304 else 200 end as http_status from documents)"


@query("content_dedupe_upsert", f"with {_FETCH} select company_id, kind, content_hash, arg_min(url, seq) as url, min(seq) as first_seq, max(seq) as last_seq, arg_max(http_status, seq) as http_status, count(*)::bigint as fetches from fetched group by company_id, kind, content_hash")
def content_dedupe_upsert(spark, d):
    t = table(spark, d, "documents")
    f = t.select((F.col("doc_id") % 40).alias("company_id"), F.col("lang").alias("kind"), F.col("source").alias("url"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 9 == 0, 304).otherwise(200).alias("http_status"))
    return writes.contents(f, ["company_id", "kind"])


_MARK = "case page_id % 7 when 0 then '<a href=\"/Warenkorb\">' when 1 then '<script src=\"//cdn.shopify.com/x\">' when 2 then 'wp-content WooCommerce' when 3 then '<i class=\"jtl_token mini-cart\">' when 4 then '<script src=\"https://widgets.TrustedShops.com\">' else '' end"


@query(
    "platform_detect",
    f"with m as (select page_id, html || {_MARK} as html from pages) select page_id, case when regexp_matches(html, 'jtl-nav-wrapper|jtl-validate|jtl_token|jtlPackFormTranslations') then 'JTL' when contains(html, 'cdn.shopify.com') then 'Shopify' when contains(html, '/bundles/storefront/') then 'Shopware' when contains(lower(html), 'wp-content') and contains(lower(html), 'woocommerce') then 'WooCommerce' end as platform from m",
)
def platform_detect(spark, d):
    return _marked(spark, d).select("page_id", documents.platform(F.col("html")).alias("platform"))


_CARTS = "[" + ", ".join(f"'{c}'" for c in documents.CART) + "]"


@query("cart_signal", f"with m as (select page_id, lower(html || {_MARK}) as html from pages) select page_id, list_filter({_CARTS}, lambda c: contains(html, c))[1] as marker from m")
def cart_signal(spark, d):
    return _marked(spark, d).select("page_id", documents.cart_marker(F.col("html")).alias("marker"))


@query("trust_badge", f"select page_id, regexp_matches(html || {_MARK}, '(?i)trustedshops|trustbadge') as badge from pages")
def trust_badge(spark, d):
    return _marked(spark, d).select("page_id", documents.trust_badge(F.col("html")).alias("badge"))


def _marked(spark, d):
    marks = ['<a href="/Warenkorb">', '<script src="//cdn.shopify.com/x">', "wp-content WooCommerce", '<i class="jtl_token mini-cart">', '<script src="https://widgets.TrustedShops.com">', "", ""]
    return table(spark, d, "pages").select("page_id", F.concat("html", F.element_at(F.array(*map(F.lit, marks)), (F.col("page_id") % 7 + 1).cast("int"))).alias("html"))


_GAPS = "regexp_replace(regexp_replace(html, '(?s)<style.*?</style>|<script.*?</script>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
_TEXT = f"trim(regexp_replace(replace(replace(replace(regexp_replace({_GAPS}, '&amp;?', '&', 'g'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '\\s+', ' ', 'g'))"


@query("html_visible_text", f"select page_id, length({_TEXT})::bigint as chars, sha256({_TEXT}) as text_sha256 from pages")
def html_visible_text(spark, d):
    p = table(spark, d, "pages").select("page_id", documents.parsed(F.col("html")).alias("page"))
    return p.select("page_id", F.length("page.text").cast("bigint").alias("chars"), F.sha2(F.col("page.text").cast("binary"), 256).alias("text_sha256"))


@query(
    "html_links",
    "with l as (select page_id, url, html, regexp_extract_all(html, '<a href=\"([^\"]*)\">[^<]*</a>', 1) as h, regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1) as t from pages),"
    " r as (select page_id, url, unnest(range(0, len(h)))::integer as position, unnest(h) as href, unnest(t) as text from l)"
    " select page_id, position, regexp_extract(url, '^[a-z]+://[^/?#]+') || href as target, trim(regexp_replace(text, '&amp;?', '&', 'g')) as text, false as in_footer from r",
)
def html_links(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", documents.parsed(F.col("html")).alias("page"))
    links = p.select("page_id", "url", F.posexplode("page.links").alias("position", "link"))
    return links.select("page_id", "position", urls.absolute(F.col("url"), F.col("link.href")).alias("target"), "link.text", "link.in_footer").where("target is not null")


def _stating(spark, d):
    """The pages with something to read behind their own content, by page_id, so that the expected facts are known."""
    n = F.col("page_id")
    number = n.cast("string")
    more = [
        F.lit('<meta name="description" content="Beschreibung">'), F.lit('<link rel="alternate" hreflang="de-DE" href="/"><link rel="alternate" hreflang="de-at" href="/at"><link rel="alternate" hreflang="fr" href="/fr">'),
        F.concat(F.lit('<script type="application/ld+json">{"@type": "Product", "aggregateRating": {"reviewCount": "'), (n + 1).cast("string"), F.lit('"}}</script>')),
        F.lit('<script type="application/ld+json">{"@graph": [{"@type": "BlogPosting", "datePublished": "2026-01-02"}]}</script><time datetime="2025-12-31T08:00Z">x</time><time datetime="2099-01-01">y</time>'),
        F.lit("<p>IMPRESSUM Muster GmbH &amp; Co. KG, Weg 1, 53111 Bonn</p>"), F.concat(F.lit("<footer>Umgesetzt von Studio "), number, F.lit('</footer><footer><a href="https://x.de">Webdesign X</a></footer>')),
        F.lit('<footer><a href="/design">Design</a> <a href="https://x.de" title="Agentur">Kontor</a></footer><footer>Entwickelt von Y</footer>'),
    ]
    p = _pages(spark, d)
    return p.withColumn("html", F.concat("html", F.element_at(F.array(*more), (n % len(more) + 1).cast("int"))))


_CREDIT = "case page_id % 7 when 5 then 'Umgesetzt von Studio ' || page_id when 6 then 'Kontor Agentur' end"


@query("html_footer_credit", f"select page_id, {_CREDIT} as credit from pages")
def html_footer_credit(spark, d):
    p = _stating(spark, d).select("page_id", "site", documents.parsed(F.col("html")).alias("page"))
    return p.select("page_id", documents.footer_credit(F.col("page"), F.col("site")).alias("credit"))


@query(
    "html_facts",
    "select page_id, case when page_id % 7 = 0 then 12 end as description_length, case when page_id % 7 = 1 then 2 end as languages, page_id % 7 = 3 as article, page_id % 7 = 2 as product, case when page_id % 7 = 2 then page_id + 1 end::bigint as reviews,"
    " case when page_id % 7 = 3 then 2 else 0 end as post_dates, case when page_id % 7 = 4 then 'GmbH & Co. KG' end as legal_form from pages",
)
def html_facts(spark, d):
    """Homepage facts: description, languages, schema types, reviews, post dates, legal form."""
    today = F.lit("2026-08-15").cast("date")
    p = _stating(spark, d).select("page_id", "site", documents.parsed(F.col("html")).alias("page"))
    p = p.select("*", documents.jsonld(F.col("page.jsonld")).alias("ld"))
    page, ld = F.col("page"), F.col("ld")
    return p.select(
        "page_id", documents.description_length(page).alias("description_length"), documents.languages(page).alias("languages"), documents.has_article(ld["types"]).alias("article"),
        F.array_contains(ld["types"], "Product").alias("product"), ld["reviews"].alias("reviews"), F.size(documents.post_dates(page, ld, today)).alias("post_dates"), documents.legal_form(page["text"]).alias("legal_form"),
    )


@query(
    "homepage_facts",
    "with f as (select page_id as company_id, unnest([{'key': 'meta.description_length', 'n': case when page_id % 7 = 0 then 12.0::double end, 't': null::varchar}, {'key': 'i18n.hreflang_count', 'n': case when page_id % 7 = 1 then 2.0::double else 0.0::double end, 't': null},"
    f" {{'key': 'agency.footer_credit', 'n': null, 't': {_CREDIT}}}, {{'key': 'reviews.trusted_shops', 'n': 0.0, 't': null}}, {{'key': 'reviews.count', 'n': case when page_id % 7 = 2 then (page_id + 1)::double end, 't': null}}, {{'key': 'shop.cart_absent', 'n': 1.0, 't': null}}]) as f from pages)"
    " select company_id, f.key, f.n as value_num, f.t as value_text from f where f.n is not null or f.t is not null",
)
def homepage_facts(spark, d):
    from attesta.operators import extraction

    return extraction.homepage_facts(_stating(spark, d).select(F.col("page_id").alias("company_id"), "html", F.lit("example.com").alias("domain")))
