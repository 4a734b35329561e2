"""From parsed documents to facts: what is written, what stays unmeasured, and where the pages come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import urls
from attesta.operators import documents as D
from attesta.operators import sampling


def homepage_facts(pages: DataFrame) -> DataFrame:
    """(company_id, html, domain) -> long facts (company_id, key, value_num, value_text).

    Languages are written as 0 where the page was read and declares none; everything else only where
    it was measured.
    """
    read = pages.where("html is not null").withColumn("page", D.parsed(F.col("html"))).withColumn("ld", D.jsonld(F.col("page.jsonld")))
    page, ld = F.col("page"), F.col("ld")
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")

    def fact(key: str, num: Column = none, value: Column = text) -> Column:
        return F.struct(F.lit(key).alias("key"), num.cast("double").alias("value_num"), value.alias("value_text"))

    facts = F.array(
        fact("platform.detected", value=D.platform(F.col("html"))),
        fact("meta.description_length", D.description_length(page)),
        fact("i18n.hreflang_count", F.coalesce(D.languages(page), F.lit(0))),
        fact("agency.footer_credit", value=D.footer_credit(page, F.col("domain"))),
        fact("reviews.trusted_shops", D.trust_badge(F.col("html")).cast("int")),
        fact("reviews.count", ld["reviews"]),
        fact("shop.cart_absent", D.cart_marker(F.col("html")).isNull().cast("int")),
    )
    measured = F.filter(facts, lambda f: f["value_num"].isNotNull() | f["value_text"].isNotNull())
    return read.select("company_id", F.explode(measured).alias("f")).select("company_id", "f.*")


def stated_form(companies: DataFrame, read: DataFrame) -> DataFrame:
    """A legal form read from an imprint replaces the stored one; an unstated one leaves it."""
    return companies.join(read.select(F.col("company_id").alias("id"), F.col("legal_form").alias("__new")), "id", "left").withColumn("legal_form", F.coalesce("__new", "legal_form")).drop("__new")


def blog_absence(found: DataFrame) -> DataFrame:
    """What is written about a blog without a readable index. ``found``: company_id, located, sitemap_read, homepage_read.

    Located but not fetched: only that the search failed for a passing reason. Nothing located: there is
    no blog, exhaustively if both instruments were there, else naming the missing ones.
    """
    missing = F.concat_ws("+", F.when(~F.col("sitemap_read"), "sitemap"), F.when(~F.col("homepage_read"), "homepage"))
    return found.select(
        "company_id",
        F.when(~F.col("located"), F.lit(0.0)).alias("blog_exists"),
        F.when(F.col("located") | (missing != ""), F.lit(0.0)).otherwise(F.lit(1.0)).alias("exhaustive"),
        F.when(F.col("located"), "transient:index").when(missing != "", F.concat(F.lit("limit:"), missing)).alias("limit"),
    )


def product_schema(product: DataFrame, homepage: DataFrame) -> DataFrame:
    """(company_id, types, url) of good product pages and homepages -> whether products are marked up, and the page that decides.

    Only with a product page: it decides if it has the type, else the homepage does if it has it.
    """
    p = product.select("company_id", F.array_contains("types", "Product").alias("p"), F.col("url").alias("p_url"))
    h = homepage.select("company_id", F.array_contains("types", "Product").alias("h"), F.col("url").alias("h_url"))
    both = p.join(h, "company_id", "left")
    by_home = ~F.col("p") & F.coalesce("h", F.lit(False))
    return both.select("company_id", (F.col("p") | by_home).cast("double").alias("value_num"), F.when(by_home, F.col("h_url")).otherwise(F.col("p_url")).alias("evidence_url"))


def imprint_link(links: DataFrame) -> DataFrame:
    """(company_id, domain, position, url, text, in_footer) -> the first imprint link on the own site, the footer's first.

    Where a page has footer links only those are looked at.
    """
    anywhere = F.max(F.col("in_footer").cast("int")).over(Window.partitionBy("company_id"))
    seen = links.withColumn("any_footer", anywhere).where((F.col("any_footer") == 0) | F.col("in_footer"))
    named = seen.where(urls.same_site(F.col("url"), F.col("domain")) & (F.regexp_like("text", F.lit(D.IMPRINT)) | F.regexp_like(urls.path(F.col("url")), F.lit(D.IMPRINT))))
    return named.groupBy("company_id").agg(F.min_by("url", "position").alias("url"))


def imprint_candidates(base: Column, link: Column) -> Column:
    """Addresses to try in order: the link, then the probes."""
    return F.array_distinct(F.array_compact(F.array(link, *[F.concat(base, F.lit(p)) for p in D.IMPRINT_PROBES])))


def imprint_result(tries: DataFrame) -> DataFrame:
    """(company_id, seq, url, final_url, status) -> the first good page that is not the root; without one, ``failed``."""
    good = (F.col("status") == 200) & (urls.path(F.col("final_url")) != "/")
    found = tries.groupBy("company_id").agg(F.min_by(F.when(good, F.col("url")), F.when(good, F.col("seq"))).alias("url"))
    return found.withColumn("failed", F.col("url").isNull())


def blog_anchor(links: DataFrame) -> DataFrame:
    """(company_id, domain, url, text) -> the blog named by a link's text: own site first, then shallow, short text, small address."""
    word = r"(?iU)(?<![^\W\d_])(?:" + "|".join(D.BLOG_WORDS) + r")(?![^\W\d_])"
    named = links.where(F.regexp_like("text", F.lit(word)))
    rank = F.struct((~urls.same_site(F.col("url"), F.col("domain"))).alias("elsewhere"), urls.segment_depth(urls.path(F.col("url"))).alias("depth"), F.length("text").alias("chars"), F.col("url").alias("url"))
    return named.groupBy("company_id").agg(F.min(rank).alias("r")).select("company_id", "r.url")


def product_sample(history: DataFrame, candidates: DataFrame, dead: DataFrame) -> DataFrame:
    """The last stored sample where it is still good, else the best candidate that is not dead.

    ``history``: company_id, url, http_status, at. ``candidates``: company_id, tier, url.
    """
    last = history.groupBy("company_id").agg(F.max_by(F.struct("url", "http_status"), "at").alias("l")).where("l.http_status = 200").select("company_id", F.lit("stored").alias("tier"), F.col("l.url").alias("url"))
    fresh = sampling.tiered(candidates.join(last, "company_id", "left_anti"), ["company_id"], dead)
    return last.unionByName(fresh)


def citations(candidates: DataFrame, listings: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(url) -> the stored artifact of the first document that lists it. ``listings``: url, document, seq."""
    first = listings.groupBy("url").agg(F.min_by("document", "seq").alias("document"))
    return candidates.join(first, "url").join(artifacts.select(F.col("url").alias("document"), F.col("id").alias("artifact_id")), "document", "left").select("url", "document", "artifact_id")


def origin_policies(artifacts: DataFrame) -> DataFrame:
    """(company_id, authority) -> the newest robots row that says something: a 200 without a body does not."""
    rows = artifacts.where("kind = 'robots' and not (http_status = 200 and body is null)")
    return rows.groupBy("company_id", "authority").agg(F.max_by(F.struct("http_status", "body"), F.struct("fetched_at", "id")).alias("r")).select("company_id", "authority", "r.http_status", "r.body")


def permissions(wanted: DataFrame, policies: DataFrame, agent: str, most_delay: float = 10.0) -> DataFrame:
    """(company_id, url) with ``allowed``: an origin without a policy, or with too long a delay, is refused."""
    by = wanted.withColumn("authority", urls.authority(F.col("url"))).join(policies, ["company_id", "authority"], "left")
    rules = D.robots_rules(F.coalesce(F.col("body").cast("string"), F.lit("")), F.lit(agent), F.col("url"))
    by = by.withColumn("state", F.when(F.col("http_status").isNull(), F.lit("deny")).otherwise(D.robots_state(F.col("http_status")))).withColumn("rules", rules)
    ok = F.when(F.col("state") == "deny", False).when(F.col("state") == "unrestricted", True).otherwise(F.col("rules.allowed") & (F.coalesce("rules.delay", F.lit(0.0)) <= most_delay))
    return by.select("company_id", "url", ok.alias("allowed"))


def frontier(documents: DataFrame, roots: DataFrame, site_of: str = "site", most: int = 50) -> DataFrame:
    """Sitemap documents reached from the roots, at most ``most`` a site, each once, in the order of a breadth-first queue.

    ``documents``: site, url, children (array of addresses). ``roots``: site, url, and seq where their order
    matters (else by address). A level's addresses are numbered in the order in which the level before lists
    them, so the cut keeps what a queue would have read. Driven by depth: every round joins one level, is
    checkpointed where a checkpoint folder is set, and stops when a level is empty.
    """
    seq = F.col("seq") if "seq" in roots.columns else F.row_number().over(Window.partitionBy(site_of).orderBy("url"))
    level = roots.select(site_of, "url", seq.cast("long").alias("seq")).groupBy(site_of, "url").agg(F.min("seq").alias("seq"))
    known = level.withColumn("depth", F.lit(0))
    durable = documents.sparkSession.sparkContext.getCheckpointDir() is not None
    depth = 0
    while depth < most and not level.isEmpty():
        depth += 1
        listed = level.join(documents, [site_of, "url"]).select(site_of, "seq", F.posexplode("children").alias("position", "url")).where(urls.same_site(F.col("url"), F.col(site_of)))
        first = listed.groupBy(site_of, "url").agg(F.min(F.struct("seq", "position")).alias("at")).join(known, [site_of, "url"], "left_anti")
        level = first.withColumn("seq", F.row_number().over(Window.partitionBy(site_of).orderBy("at")).cast("long")).select(site_of, "url", "seq")
        level = level.checkpoint() if durable else level
        known = known.unionByName(level.withColumn("depth", F.lit(depth)))
    nth = F.row_number().over(Window.partitionBy(site_of).orderBy("depth", "seq"))
    return known.withColumn("nth", nth).where(F.col("nth") <= most).select(site_of, "url", "depth", "nth")


def required_paths(policies: DataFrame, agent: str) -> DataFrame:
    """(company_id, authority, reason): policies that forbid what a reading needs, with the first thing they forbid.

    That is the root, the sitemap, or every address at which an imprint may stand. Only a policy that was read
    can forbid; one that could not be is a matter of the day and gives no row.
    """
    wanted = F.array(*[F.struct(F.lit(what).alias("what"), F.lit(path).alias("path")) for what, path in (("/", "/"), ("/sitemap.xml", "/sitemap.xml"), *(("imprint", p) for p in D.IMPRINT_PROBES))])
    read = policies.where((D.robots_state(F.col("http_status")) == "parsed") & F.col("body").isNotNull()).select("company_id", "authority", F.col("body").cast("string").alias("body"), F.explode(wanted).alias("w"))
    rules = D.robots_rules(F.col("body"), F.lit(agent), F.concat(F.lit("https://"), "authority", "w.path"))
    asked = read.select("company_id", "authority", "w.what", rules["allowed"].alias("allowed")).groupBy("company_id", "authority", "what").agg(F.bool_or("allowed").alias("allowed"))
    blocked = asked.groupBy("company_id", "authority").agg(F.collect_set(F.when(~F.col("allowed"), F.col("what"))).alias("b"))
    order = [("/", "/ is disallowed"), ("/sitemap.xml", "/sitemap.xml is disallowed"), ("imprint", "every imprint path is disallowed")]
    reason = F.coalesce(*[F.when(F.array_contains("b", what), F.lit(f"robots_disallowed: {text}")) for what, text in order])
    return blocked.select("company_id", "authority", reason.alias("reason")).where("reason is not null")
