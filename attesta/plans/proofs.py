"""Queries for operators that the other plans do not reach: batches, runs, samples, reviews and erasure."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import text, urls
from attesta.operators import batches, extraction, listing, logs, planning, review, sampling, snapshots, verification, writes
from attesta.plans.registry import query, table
from attesta.plans.web import _AUTH, _PATH
from attesta.sources import adapters as A


@query(
    "releasable_batches",
    "with p as (select max(o_orderdate) as newest from orders where o_orderstatus = 'F' and o_orderdate < timestamp '1999-01-01')"
    " select o_orderkey as id from orders, p where o_orderstatus = 'O' and o_orderkey % 3 <> 0 and o_orderdate > newest",
)
def releasable_batches(spark, d):
    o = table(spark, d, "orders")
    mine = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "reserved").otherwise("submitted").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("submitted_at"), F.col("o_orderdate").alias("reserved_at"))
    provider = o.where("o_orderstatus = 'F' and o_orderdate < timestamp'1999-01-01'").select(F.col("o_orderdate").alias("created_at"))
    return batches.releasable(mine, provider).select("id")


@query(
    "settled_requests",
    "with r as (select distinct l_orderkey as batch_id, l_linenumber as custom_id, case when l_orderkey % 4 = 0 then 'succeeded' end as outcome from lineitem),"
    " i as (select l_orderkey as batch_id, l_linenumber as custom_id, arg_min(case l_partkey % 3 when 0 then 'expired' when 1 then 'server_error' else 'succeeded' end, l_partkey) as arrived from lineitem where l_partkey % 7 <> 0 group by all)"
    " select r.batch_id, r.custom_id, coalesce(r.outcome, i.arrived) as outcome from r left join i on i.batch_id = r.batch_id and i.custom_id = r.custom_id",
)
def settled_requests(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("custom_id"), F.col("l_partkey").alias("seq"))
    requests = li.select("batch_id", "custom_id", F.when(F.col("batch_id") % 4 == 0, "succeeded").alias("outcome")).distinct()
    outcome = F.when(F.col("seq") % 3 == 0, "expired").when(F.col("seq") % 3 == 1, "server_error").otherwise("succeeded")
    return batches.settled(requests, li.where("seq % 7 <> 0").withColumn("outcome", outcome))


@query("reproducible_texts", "select cast(doc_id as varchar) as custom_id, sha256(text) = case when doc_id % 3 = 0 then sha256('other') else sha256(text) end as same from documents")
def reproducible_texts(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("artifact_id"), "text")
    sent = t.select(F.col("artifact_id").cast("string").alias("custom_id"), "artifact_id", text.sha256(F.when(F.col("artifact_id") % 3 == 0, "other").otherwise(F.col("text"))).alias("sent_text_sha256"))
    return batches.reproducible(sent, t)


@query(
    "failing_days",
    f"with a as (select page_id % 50 as company_id, {_AUTH} as authority, page_id % 14 <> 0 and page_id % 5 <> 0 as good, timestamp '2024-01-01' + to_days(cast(page_id % 30 as integer)) as at1 from pages where page_id % 7 = 0),"
    " g as (select company_id, authority, max(case when good then at1 end) as good_at from a group by all),"
    " s as (select a.company_id, a.authority, min(at1) as since from a join g on g.company_id = a.company_id and g.authority = a.authority where not good and (good_at is null or at1 > good_at) group by all)"
    " select s.company_id, s.authority, count(distinct cast(ts as date))::bigint as days from s join events e on e.user_id % 50 = s.company_id and e.ts >= s.since group by all",
)
def failing_days(spark, d):
    n = F.col("page_id")
    p = table(spark, d, "pages").select(
        (n % 50).alias("company_id"), F.when(n % 7 == 0, "robots").otherwise("page").alias("kind"), urls.authority(F.col("url")).alias("authority"), F.when(n % 14 == 0, 503).otherwise(200).alias("http_status"),
        F.when(n % 5 != 0, F.lit("hash")).alias("content_hash"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=n % 30)).alias("fetched_at"),
    )
    return logs.failing_days(p, table(spark, d, "events").select((F.col("user_id") % 50).alias("company_id"), F.col("ts").cast("timestamp").alias("started_at")))


@query(
    "current_artifacts",
    "with g as (select doc_id as id, doc_id % 40 as company_id, ['homepage', 'impressum', 'blog_index'][doc_id % 3 + 1] as kind, source as url, sha256(text) as content_hash, doc_id % 97 as at1 from documents where doc_id % 9 <> 0 and text is not null),"
    " h as (select * from (select *, row_number() over (partition by company_id order by at1 desc, id desc) as rn from g where kind = 'homepage') x where rn = 1),"
    " k as (select g.*, row_number() over (partition by g.company_id, g.kind order by g.at1 desc, g.id desc) as rn from g join h on h.company_id = g.company_id where (g.kind = 'homepage' and g.id = h.id) or (g.kind <> 'homepage' and g.at1 >= h.at1 and not (g.kind = 'impressum' and g.content_hash = h.content_hash)))"
    " select company_id, kind, id, url, content_hash, at1 as last_checked_at from k where rn = 1",
)
def current_artifacts(spark, d):
    n = F.col("doc_id")
    t = table(spark, d, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("homepage", "impressum", "blog_index"))), (n % 3 + 1).cast("int"))
    rows = t.select(n.alias("id"), (n % 40).alias("company_id"), kind.alias("kind"), F.col("source").alias("url"), text.sha256(F.col("text")).alias("content_hash"), F.when(n % 9 == 0, 404).otherwise(200).alias("http_status"), (n % 97).alias("last_checked_at"))
    return sampling.current_artifacts(rows)


@query(
    "product_schema",
    "with p as (select c_custkey as company_id, c_custkey % 2 = 0 as p from customer where c_custkey % 3 <> 0), h as (select c_custkey as company_id, c_custkey % 7 < 3 as h from customer where c_custkey % 5 <> 0)"
    " select p.company_id, case when p.p or coalesce(h.h, false) then 1.0::double else 0.0::double end as value_num, case when not p.p and coalesce(h.h, false) then 'home' || p.company_id else 'product' || p.company_id end as evidence_url from p left join h on h.company_id = p.company_id",
)
def product_schema(spark, d):
    n = F.col("c_custkey")
    c = table(spark, d, "customer")

    def pages(has, name: str):
        return c.select(n.alias("company_id"), F.array(F.when(has, "Product").otherwise("Offer")).alias("types"), F.concat(F.lit(name), n.cast("string")).alias("url"))

    return extraction.product_schema(pages(n % 2 == 0, "product").where("company_id % 3 <> 0"), pages(n % 7 < 3, "home").where("company_id % 5 <> 0"))


@query(
    "imprint_result",
    "with t as (select l_orderkey as company_id, l_linenumber as seq, 'https://a.de/' || l_linenumber as url, l_partkey % 3 = 0 and l_partkey % 2 = 1 as good from lineitem),"
    " r as (select company_id, arg_min(url, seq) filter (where good) as url from t group by company_id) select company_id, url, url is null as failed from r",
)
def imprint_result(spark, d):
    li = table(spark, d, "lineitem")
    url = F.concat(F.lit("https://a.de/"), F.col("l_linenumber").cast("string"))
    final = F.when(F.col("l_partkey") % 2 == 0, "https://a.de/").otherwise("https://a.de/impressum")
    return extraction.imprint_result(li.select(F.col("l_orderkey").alias("company_id"), F.col("l_linenumber").alias("seq"), url.alias("url"), final.alias("final_url"), F.when(F.col("l_partkey") % 3 == 0, 200).otherwise(404).alias("status")))


@query(
    "competitor_brands",
    "with f as (select p_size as company_id, lower(b) as key, min((q, p_partkey, b)) as f from (select *, p_partkey % 3 as q, case when p_partkey % 2 = 0 then upper(p_brand) else p_brand end as b from part) x group by all)"
    " select company_id, array_to_string(list_transform(list_sort(list(f)), lambda x: x[3]), ',') as brands from f group by company_id",
)
def competitor_brands(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.col("p_size").alias("company_id"), (F.col("p_partkey") % 3).alias("query_no"), F.col("p_partkey").alias("position"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("brand"))
    return verification.competitors(rows).select("company_id", F.array_join("brands", ",").alias("brands"))


@query(
    "erasure_residue",
    "select 'score' as \"table\", count(*) filter (o_custkey = 7)::bigint as rows from orders union all select 'signal', count(*) filter (l_suppkey = 7)::bigint from lineitem"
    " union all select 'company', count(*) filter (c_custkey = 7)::bigint from customer union all select 'score_component', count(*) filter (o_custkey = 7)::bigint from lineitem join orders on l_orderkey = o_orderkey",
)
def erasure_residue(spark, d):
    tables = {
        "score": table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id")), "signal": table(spark, d, "lineitem").select(F.col("l_suppkey").alias("company_id")),
        "company": table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "score_component": table(spark, d, "lineitem").select(F.col("l_orderkey").alias("score_id")),
    }
    return review.residue(tables, 7)


@query(
    "next_steps",
    f"with {A.COMPANY}, k as (select id from company where not excluded), a as (select distinct o_custkey as id from orders), s as (select distinct o_custkey as id from orders where o_orderstatus = 'P'), f as (select distinct o_custkey as id from orders where o_orderpriority like '1%' and o_orderstatus = 'O'),"
    " w as (select 'fetch' as step from k where id not in (select id from a) union all select 'score' from k where id in (select id from a) and id not in (select id from s) union all select 'review' from k where id in (select id from f))"
    " select step, count(*)::bigint as companies from w group by step",
)
def next_steps(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("company_id"), "o_orderstatus", "o_orderpriority", "o_orderdate")
    flags = o.where("o_orderpriority like '1%'").withColumn("resolved_at", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")))
    return review.next_steps(A.companies(spark, d), o, o.where("o_orderstatus = 'P'"), flags)


@query("run_states", f"with {A.RUN} select id, case when aborted_reason is not null then 'aborted' when finished_at is not null then 'finished' else 'open' end as state from run")
def run_states(spark, d):
    return A.runs(spark, d).select("id", listing.run_state(F.col("finished_at"), F.col("aborted_reason")).alias("state"))


@query("comparable_runs", f"with {A.RUN}, {A.SIGNAL} select id from run where stage = 'extract_p1' and id in (select run_id from signal where confidence > 0) order by id desc limit 2")
def comparable_runs(spark, d):
    return snapshots.comparable_runs(A.runs(spark, d), A.signals(spark, d).where("confidence > 0"), "extract_p1").select("id")


@query(
    "unreconciled_batches",
    f"with {A.COMPANY}, b as (select o_orderkey as id, o_orderpriority as purpose from orders where o_orderstatus = 'O'), r as (select distinct l_orderkey as batch_id, l_suppkey as company_id from lineitem)"
    " select b.id as batch_id, b.purpose, coalesce(string_agg(distinct c.domain, ', ' order by c.domain), '') as domains from b left join r on r.batch_id = b.id left join company c on c.id = r.company_id and not c.excluded group by b.id, b.purpose",
)
def unreconciled_batches(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("purpose"), F.col("o_orderdate").alias("submitted_at"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("reconciled_at"), F.lit(None).cast("timestamp").alias("released_at"))
    return planning.unreconciled(rows, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_suppkey").alias("company_id")), A.companies(spark, d))


@query("fetch_failures", "select doc_id % 40 as company_id, source as url, min(doc_id) as first_seq, arg_max('e' || doc_id, doc_id) as error from documents where doc_id % 9 = 0 group by all")
def fetch_failures(spark, d):
    n = F.col("doc_id")
    f = table(spark, d, "documents").select((n % 40).alias("company_id"), F.col("source").alias("url"), n.alias("seq"), F.when(n % 9 != 0, "hash").alias("content_hash"), F.concat(F.lit("e"), n.cast("string")).alias("error"))
    return writes.failures(f, ["company_id"])


@query(
    "exclusion_decisions",
    f"with {A.COMPANY}, l as (select o_custkey as id, arg_max(o_orderkey % 2 = 0, o_orderkey) as x, max(o_orderkey) as at1 from orders group by o_custkey)"
    " select c.id, coalesce(l.x, c.excluded) as excluded, case when l.id is not null then case when l.x then 'r' || at1 end end as excluded_reason from company c left join l on l.id = c.id",
)
def exclusion_decisions(spark, d):
    n = F.col("o_orderkey")
    decisions = table(spark, d, "orders").select(F.col("o_custkey").alias("company_id"), n.alias("at"), (n % 2 == 0).alias("exclude"), F.concat(F.lit("r"), n.cast("string")).alias("reason"))
    return review.excluded(A.companies(spark, d).withColumn("excluded_reason", F.lit(None).cast("string")), decisions).select("id", "excluded", "excluded_reason")


@query(
    "flag_resolutions",
    "with f as (select user_id as company_id, event_type as reason, min(event_id) as raised_at, max(case when event_id % 50 = 0 then event_id end) as resolved_at from events group by all), r as (select user_id as company_id, event_type as reason, min(event_id) as at1 from events where event_id % 8 = 0 group by all)"
    " select f.company_id, f.reason, coalesce(f.resolved_at, r.at1) as resolved_at from f left join r on r.company_id = f.company_id and r.reason = f.reason",
)
def flag_resolutions(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("company_id"), F.col("event_type").alias("reason"), F.col("event_id").alias("at"))
    flags = review.flag_state(e.withColumn("resolves", F.col("at") % 50 == 0))
    return review.resolved(flags, e.where("at % 8 = 0")).select("company_id", "reason", "resolved_at")


@query(
    "manufacturers",
    "with c as (select c_custkey as id from customer where c_mktsegment = 'BUILDING'), f as (select o_custkey as id, max(case when o_orderkey % 2 = 0 then o_orderkey % 4 / 2 end) as absent, max(case when o_orderkey % 2 = 1 then o_orderkey % 3 end) as products from orders group by o_custkey)"
    " select c.id from c join f on f.id = c.id where absent = 1 and coalesce(products, 0) = 0",
)
def manufacturers(spark, d):
    n = F.col("o_orderkey")
    companies = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "llm_websearch").otherwise("seed").alias("discovery_source"))
    facts = table(spark, d, "orders").select(F.col("o_custkey").alias("company_id"), F.when(n % 2 == 0, "shop.cart_absent").otherwise("catalog.product_url_count").alias("key"), F.when(n % 2 == 0, n % 4 / 2).otherwise(n % 3).cast("double").alias("value_num"))
    return review.manufacturers(companies, facts)


@query("shallowest_page", f"with p as (select page_id % 25 as grp, url, len(regexp_replace(regexp_replace({_PATH}, '/+$', ''), '[^/]', '', 'g')) as depth from pages) select grp, arg_min(url, (depth, url)) as url from p group by grp")
def shallowest_page(spark, d):
    return sampling.shallowest(table(spark, d, "pages").select((F.col("page_id") % 25).alias("grp"), "url"), ["grp"])


@query(
    "last_post",
    "with m as (select o_custkey as id, max(case when o_orderstatus = 'F' then cast(o_orderdate as date) end) as i, max(case when o_orderkey % 3 = 0 then cast(o_orderdate as date) end) as a from orders group by o_custkey)"
    " select id, case when i is null then a when a is null then i else greatest(i, a) end as day, case when i is null and a is null then null when i = a then 'both' when a is null or i > a then 'index' else 'article' end as basis from m",
)
def last_post(spark, d):
    day = F.to_date("o_orderdate")
    m = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.when(F.col("o_orderstatus") == "F", day)).alias("i"), F.max(F.when(F.col("o_orderkey") % 3 == 0, day)).alias("a"))
    return m.select("id", sampling.last_post(F.col("i"), F.col("a")).alias("l")).select("id", "l.*")


@query(
    "brand_terms",
    f"with {A.COMPANY}, t as (select id, domain, regexp_extract(domain, '^([^.]+)', 1) as label, 'Shop ' || id as name from company) select id, lower(domain) || case when length(label) >= 4 then ',' || lower(label) else '' end || case when length(name) >= 4 then ',' || lower(name) else '' end as terms from t",
)
def brand_terms(spark, d):
    c = A.companies(spark, d).withColumn("legal_name", F.concat(F.lit("Shop "), F.col("id").cast("string"), F.lit(" GmbH & Co. KG")))
    return c.select("id", F.array_join(text.brand_terms(F.col("domain"), F.col("legal_name")), ",").alias("terms"))


@query(
    "origin_policies",
    f"with r as (select page_id % 20 as company_id, {_AUTH} as authority, page_id, case when page_id % 4 = 0 then 503 else 200 end as http_status, case when page_id % 3 <> 0 then html end as body from pages where page_id % 2 = 0 or page_id % 5 = 0)"
    " select company_id, authority, arg_max(http_status, page_id) as http_status, sha256(coalesce(arg_max(coalesce(body, ''), page_id), '')) as body_sha256 from r where not (http_status = 200 and body is null) group by all",
)
def origin_policies(spark, d):
    n = F.col("page_id")
    p = table(spark, d, "pages").select(
        (n % 20).alias("company_id"), urls.authority(F.col("url")).alias("authority"), F.when((n % 2 == 0) | (n % 5 == 0), "robots").otherwise("page").alias("kind"), F.when(n % 4 == 0, 503).otherwise(200).alias("http_status"),
        F.when(n % 3 != 0, F.col("html")).alias("body"), n.alias("fetched_at"), n.alias("id"),
    )
    return extraction.origin_policies(p).select("company_id", "authority", "http_status", text.sha256(F.coalesce("body", F.lit(""))).alias("body_sha256"))
