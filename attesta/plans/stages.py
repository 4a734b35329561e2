"""Extraction, planning and discovery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import extraction, planning
from attesta.plans.registry import query, table
from attesta.sources import adapters as A


@query("last_stage_start", f"with {A.RUN} select max(started_at) as started_at from run where stage = 'extract_p1' and aborted_reason is null")
def last_stage_start(spark, d):
    return planning.last_start(A.runs(spark, d), "extract_p1")


@query(
    "blog_absence",
    "with f as (select user_id as company_id, user_id % 4 = 0 as located, user_id % 3 <> 0 as s, user_id % 5 <> 0 as h from (select distinct user_id from events) u),"
    " m as (select *, case when not s and not h then 'sitemap+homepage' when not s then 'sitemap' when not h then 'homepage' else '' end as missing from f)"
    " select company_id, case when not located then 0.0::double end as blog_exists, case when located or missing <> '' then 0.0::double else 1.0::double end as exhaustive, case when located then 'transient:index' when missing <> '' then 'limit:' || missing end as \"limit\" from m",
)
def blog_absence(spark, d):
    u = table(spark, d, "events").select(F.col("user_id").alias("company_id")).distinct()
    n = F.col("company_id")
    return extraction.blog_absence(u.select("company_id", (n % 4 == 0).alias("located"), (n % 3 != 0).alias("sitemap_read"), (n % 5 != 0).alias("homepage_read")))


@query(
    "sample_reuse",
    "with h as (select page_id % 30 as company_id, url, case when page_id % 4 = 0 then 404 else 200 end as st, page_id as at1 from pages),"
    " l as (select company_id, arg_max(url, at1) as url, arg_max(st, at1) as st from h group by company_id), good as (select company_id, url from l where st = 200),"
    " c as (select page_id % 30 as company_id, case when page_id % 2 = 0 then 1 else 3 end as rank, url from pages where url not in (select url from pages where page_id % 10 = 1)),"
    " b as (select company_id, min(rank) as rank from c group by company_id)"
    " select company_id, 'stored' as tier, url from good union all select c.company_id, case b.rank when 1 then 'sitemap' else 'links' end, min(c.url) from c join b on b.company_id = c.company_id and b.rank = c.rank where c.company_id not in (select company_id from good) group by c.company_id, b.rank",
)
def sample_reuse(spark, d):
    p = table(spark, d, "pages")
    company = (F.col("page_id") % 30).alias("company_id")
    history = p.select(company, "url", F.when(F.col("page_id") % 4 == 0, 404).otherwise(200).alias("http_status"), F.col("page_id").alias("at"))
    candidates = p.select(company, F.when(F.col("page_id") % 2 == 0, "sitemap").otherwise("links").alias("tier"), "url")
    return extraction.product_sample(history, candidates, p.where("page_id % 10 = 1").select("url"))


@query("citation_lookup", "with l as (select url, arg_min(page_id % 20, page_id) as doc from pages group by url) select p.url, cast(l.doc as varchar) as document, case when l.doc < 15 then l.doc end as artifact_id from (select distinct url from pages) p join l on l.url = p.url")
def citation_lookup(spark, d):
    p = table(spark, d, "pages")
    doc = F.col("page_id") % 20
    artifacts = spark.range(15).select(F.col("id").cast("string").alias("url"), "id")
    return extraction.citations(p.select("url").distinct(), p.select("url", doc.cast("string").alias("document"), F.col("page_id").alias("seq")), artifacts)


@query(
    "extraction_inputs",
    # A company for every customer; every seventh document answered 404.
    "with a as (select doc_id % 60 as company_id, doc_id as artifact_id, text from (select *, case when doc_id % 7 = 0 then 404 else 200 end as http_status from documents) d where http_status = 200 and text <> ''), n as (select company_id, max(artifact_id) as artifact_id, arg_max(text, artifact_id) as text from a group by company_id),"
    " g as (select c_custkey as company_id, case when c_custkey % 5 = 0 then 'stopped' when c_custkey % 5 = 1 then null else 'admitted' end as verdict from customer)"
    " select g.company_id, n.artifact_id, case when coalesce(verdict, 'unscored') <> 'admitted' then coalesce(verdict, 'unscored') when n.artifact_id is null then 'no_page' end as skipped from g left join n on n.company_id = g.company_id",
)
def extraction_inputs(spark, d):
    t = table(spark, d, "documents").select((F.col("doc_id") % 60).alias("company_id"), F.col("doc_id").alias("artifact_id"), F.lit("impressum").alias("kind"), F.when(F.col("doc_id") % 7 == 0, 404).otherwise(200).alias("http_status"), "text", F.col("doc_id").alias("at"))
    n = F.col("company_id")
    some = table(spark, d, "customer").select(F.col("c_custkey").alias("company_id"))
    gate = some.select("company_id", F.when(n % 5 == 0, "stopped").when(n % 5 != 1, "admitted").alias("verdict"))
    return planning.prepared(some, gate, t, "impressum").select("company_id", "artifact_id", "skipped")


@query("cache_writes", "select l_orderkey, l_linenumber, count(*)::bigint as n, bool_or(case when l_quantity * 100 < 1024 then false else l_linenumber > 2 end) as seen from lineitem group by l_orderkey, l_linenumber")
def cache_writes(spark, d):
    li = table(spark, d, "lineitem")
    seen = planning.cache_write_seen(F.col("l_quantity") * 100, F.col("l_linenumber") - 2)
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.bool_or(seen).alias("seen"))


@query(
    "visibility_plan",
    f"with {A.COMPANY}, s as (select o_custkey as id, arg_max(o_totalprice, o_orderkey) as total from orders group by o_custkey),"
    " r as (select c.id, c.domain, s.total, case when c.excluded then 'excluded' when c.id % 7 = 0 then 'no_category' when c.id % 3 = 0 then 'cached' end as against from company c left join s on s.id = c.id),"
    " k as (select id from r where against is null order by total is null, total desc, domain limit 100)"
    " select r.id, coalesce(against, case when k.id is not null then 'check' end, 'beyond_limit') as verdict from r left join k on k.id = r.id",
)
def visibility_plan(spark, d):
    c = A.companies(spark, d)
    scores = table(spark, d, "orders").select(F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("phase"), F.col("o_totalprice").alias("total"))
    facts = c.select("id", F.when(F.col("id") % 7 != 0, "x").alias("category"), (F.col("id") % 3 == 0).alias("measured_recently"))
    return planning.visibility_plan(c, scores, facts, 100)
