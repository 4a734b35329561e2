"""Deterministic samples of a site: product candidates, tiered choice by code point, catalogue counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import urls

# Path patterns of products and of listings, the shape of a locale root, words in shard names.
PRODUCT_PATHS = ("/detail/", "/products/", "/produkt/")
LISTING_PATHS = ("/kategorie/", "/collections/", "/c/", "/categories/")
LOCALE_ROOT = r"(?i)^/[a-z]{2}(?:-[a-z]{2})?$"
PRODUCT_WORDS = ("product", "products", "article", "articles", "artikel", "produkte")
AMBIGUOUS_WORDS = ("article", "articles")
BLOG_SHARD_WORDS = ("blog", "blogs", "magazin", "magazine", "news", "ratgeber", "journal", "post", "posts")
NOISE_WORDS = ("sitemap", "sitemaps", "xml", "gz", "index", "area")
TIERS = ("sitemap", "pattern", "links")


def _any(condition: list[Column]) -> Column:
    out = F.lit(False)
    for c in condition:
        out = out | c
    return out


def product_candidate(url: Column, domain: Column, blog_path: Column | None = None, trusted: Column | bool = False) -> Column:
    """The URL may be a product: on the site, no query, no listing, not in the blog, and a product pattern with something
    after it. Members of a product sitemap (``trusted``) only must not be a storefront's root."""
    path = F.lower(urls.path(url))
    bare = F.regexp_replace(path, "/+$", "")
    pattern = _any([F.regexp_like(bare, F.lit(f".*?{p}.+")) for p in PRODUCT_PATHS])
    root = (bare == "") | F.regexp_like(bare, F.lit(LOCALE_ROOT))
    trusted = F.lit(trusted) if isinstance(trusted, bool) else trusted
    in_blog = F.lit(False) if blog_path is None else F.coalesce(path.startswith(F.concat(F.regexp_replace(F.lower(blog_path), "/+$", ""), F.lit("/"))), F.lit(False))
    listing = _any([F.contains(path, F.lit(p)) for p in LISTING_PATHS])
    return urls.same_site(url, domain) & ~urls.has_query(url) & ~listing & ~in_blog & F.when(trusted, ~root).otherwise(pattern)


def secondary_locale(url: Column, primary: Column, secondary: Column) -> Column:
    """A translation of what is counted elsewhere: below a declared prefix, or below a segment shaped like a locale other than the primary one."""
    path = F.coalesce(F.nullif(F.regexp_replace(urls.path(url), "/+$", ""), F.lit("")), F.lit("/"))
    first = F.regexp_extract(path, "^(/[^/]+)", 1)
    declared = F.exists(secondary, lambda p: (path == p) | path.startswith(F.concat(p, F.lit("/"))))
    return declared | ((first != "") & (first != primary) & F.regexp_like(first, F.lit(LOCALE_ROOT)))


def tiered(candidates: DataFrame, by: list[str], dead: DataFrame | None = None) -> DataFrame:
    """(by, tier, url) -> the smallest URL by code point of the best tier of each group, dead ones left out."""
    if dead is not None:
        candidates = candidates.join(dead.select("url").distinct(), "url", "left_anti")
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    return candidates.groupBy(*by).agg(F.min(F.struct(rank.alias("rank"), F.col("url").alias("url"), F.col("tier").alias("tier"))).alias("m")).select(*by, "m.tier", "m.url")


def shallowest(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The URL of least depth, then smallest."""
    return candidates.groupBy(*by).agg(F.min(F.struct(urls.slash_depth(urls.path(F.col("url"))).alias("depth"), F.col("url").alias("url"))).alias("m")).select(*by, "m.url")


def shard_words(url: Column) -> Column:
    name = F.element_at(F.split(urls.path(url), "/"), -1)
    words = F.transform(F.regexp_extract_all(name, F.lit("([A-Za-z]+)"), F.lit(1)), lambda w: F.lower(w))
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, NOISE_WORDS)))


def shard_kind(url: Column) -> Column:
    """``product`` or ``blog`` where every word of the shard's name says so; an ambiguous name stays null."""
    words = shard_words(url)
    def only(kinds):
        return (F.size(words) > 0) & F.forall(words, lambda w: w.isin(*kinds))

    return F.when(only(PRODUCT_WORDS) & ~only(AMBIGUOUS_WORDS), "product").when(only(BLOG_SHARD_WORDS), "blog")


def shard_kinds_by_content(shards: DataFrame) -> DataFrame:
    """(site, shard, url) -> (site, shard, kind): an ambiguous shard that shares more than half of its URLs with a blog shard is a blog, else products."""
    named = shards.withColumn("kind", shard_kind(F.col("shard"))).withColumn("words", shard_words(F.col("shard")))
    blog = named.where("kind = 'blog'").select("site", "url").distinct().withColumn("in_blog", F.lit(1))
    open_ = named.where((F.size("words") > 0) & F.forall("words", lambda w: w.isin(*AMBIGUOUS_WORDS))).join(blog, ["site", "url"], "left")
    decided = open_.groupBy("site", "shard").agg(F.when(F.sum(F.coalesce("in_blog", F.lit(0))) * 2 > F.count("*"), "blog").otherwise("product").alias("kind"))
    return named.where("kind is not null").select("site", "shard", "kind").distinct().unionByName(decided)


def catalogue(entries: DataFrame) -> DataFrame:
    """(site, shard, seq, url, secondary) -> products of each site, the shard that lists most of them, and whether locales were left out.

    A URL counts once, for the last shard that lists it; translations are left out unless nothing else
    is there; ties for the top shard go to the smaller name.
    """
    once = entries.groupBy("site", "url").agg(F.max_by("shard", "seq").alias("shard"), F.bool_and("secondary").alias("secondary"))
    split = once.groupBy("site", "shard").agg(F.count_if(~F.col("secondary")).alias("own"), F.count("*").alias("every"))
    total = Window.partitionBy("site")
    n = F.when(F.sum("own").over(total) > 0, F.col("own")).otherwise(F.col("every"))
    counted = split.withColumn("n", n).withColumn("filtered", (F.sum("own").over(total) > 0) & (F.sum("own").over(total) < F.sum("every").over(total)))
    return counted.where("n > 0").groupBy("site").agg(F.sum("n").alias("products"), F.min_by("shard", F.struct(-F.col("n"), "shard")).alias("top_shard"), F.bool_or("filtered").alias("filtered"))


def last_post(index_max: Column, article_max: Column) -> Column:
    """struct<day, basis>: the later of both; ``both`` or ``index`` only where the index itself shows that day."""
    day = F.greatest(index_max, article_max)
    basis = F.when(day.isNull(), None).when((index_max == day) & (article_max == day), "both").when(index_max == day, "index").otherwise("article")
    return F.struct(day.alias("day"), basis.alias("basis"))


def current_artifacts(artifacts: DataFrame) -> DataFrame:
    """The newest good homepage of each company, and of every other kind the newest good row no older than it;
    an imprint must not have the homepage's content."""
    good = artifacts.where("http_status = 200 and content_hash is not null")
    newest = F.max_by(F.struct("id", "url", "content_hash", "last_checked_at"), F.struct("last_checked_at", "id"))
    home = good.where("kind = 'homepage'").groupBy("company_id").agg(newest.alias("h")).select("company_id", F.col("h.content_hash").alias("home_hash"), F.col("h.last_checked_at").alias("home_at"), F.col("h.id").alias("home_id"))
    kept = good.join(home, "company_id").where("(kind = 'homepage' and id = home_id) or (kind <> 'homepage' and last_checked_at >= home_at and not (kind = 'impressum' and content_hash = home_hash))")
    return kept.groupBy("company_id", "kind").agg(newest.alias("a")).select("company_id", "kind", "a.*")


def blog_location(sitemap_urls: Column, links: Column, domain: Column) -> Column:
    """The first path with a blog word among sorted sitemap URLs, then links: its prefix, else null."""
    words = "|".join(("blogs", "blog", "magazin", "ratgeber", "news", "journal", "tipps"))
    shape = rf"(?i)^(/(?:[a-z]{{2}}(?:-[a-z]{{2}})?/)?(?:{words}))(?:/|$)"
    own = F.filter(F.concat(F.array_sort(sitemap_urls), links), lambda u: urls.same_site(u, domain))
    return F.get(F.filter(F.transform(own, lambda u: F.regexp_extract(urls.path(u), shape, 1)), lambda p: p != ""), 0)


def blog_index(observed: DataFrame) -> DataFrame:
    """(company_id, domain, blog_path, url, in_sitemap) -> the address under the blog's path that is its index.

    The least deep of what was seen there; at one depth a link of the homepage goes before the sitemap's,
    then the smaller address. Nothing is made up: without a URL under the path there is no row.
    """
    path, bare = urls.path(F.col("url")), F.regexp_replace("blog_path", "/+$", "")
    under = (F.regexp_replace(path, "/+$", "") == bare) | path.startswith(F.concat(bare, F.lit("/")))
    rank = F.struct(urls.segment_depth(path).alias("depth"), F.col("in_sitemap").cast("int").alias("late"), F.col("url").alias("url"))
    return observed.where(urls.same_site(F.col("url"), F.col("domain")) & under).groupBy("company_id").agg(F.min(rank).alias("r")).select("company_id", "r.url")


def located_blogs(by_path: DataFrame, by_anchor: DataFrame) -> DataFrame:
    """(company_id, path, url, basis): a blog named by a path, else one named by a link's text.

    ``by_path``: company_id, path (null for none). ``by_anchor``: company_id, domain, url. The latter gives a
    path prefix only on the company's own host and below its root.
    """
    own = F.when(urls.host(F.col("url")) == urls.host(F.concat(F.lit("https://"), "domain")), F.nullif(F.regexp_replace(urls.path(F.col("url")), "/+$", ""), F.lit("")))
    first = by_path.where("path is not null").select("company_id", "path", F.lit(None).cast("string").alias("url"), F.lit("path_vocabulary").alias("basis"))
    second = by_anchor.where("url is not null").join(first, "company_id", "left_anti").select("company_id", own.alias("path"), "url", F.lit("anchor_text").alias("basis"))
    return first.unionByName(second)
