"""Request-log analytics over the event table (a user is a host, a value the seconds a request took)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import logs
from attesta.plans.registry import query, table

_LOG = "log as (select user_id as host, epoch(ts) as issued, value as elapsed from events)"


def _log(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("host"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("issued"), F.col("value").alias("elapsed"))


@query(
    "host_spacing",
    f"with {_LOG}, gaps as (select host, issued - lag(issued) over (partition by host order by issued) as gap from log)"
    " select host, count(*)::bigint as requests, round(min(gap), 3) as min_gap, case when host % 3 = 0 then 60.0::double else 1.0::double end as owed,"
    " min(gap) is null or min(gap) >= case when host % 3 = 0 then 60.0 else 1.0 end - 0.02 as kept from gaps group by host",
)
def host_spacing(spark, d):
    log = _log(spark, d)
    owed = log.select("host").distinct().where("host % 3 = 0").withColumn("owed", F.lit(60.0))
    return logs.spacing(log, owed).select("host", "requests", F.round("min_gap", 3).alias("min_gap"), "owed", "kept")


@query(
    "max_in_flight",
    f"with {_LOG}, real as (select host, issued as s, issued + elapsed as e from log where elapsed > 0),"
    " r as (select *, max(e) over (partition by host order by s, e rows between unbounded preceding and 1 preceding) as reached from real),"
    " m as (select *, sum(case when reached is null or s >= reached then 1 else 0 end) over (partition by host order by s, e rows unbounded preceding) as span from r),"
    " spans as (select host, min(s) as s, max(e) as e from m group by host, span),"
    " steps as (select s as t, 1 as d from spans union all select e, -1 from spans)"
    " select coalesce(max(live), 0)::bigint as max_in_flight from (select sum(d) over (order by t, d rows unbounded preceding) as live from steps) x",
)
def max_in_flight(spark, d):
    return logs.most_in_flight(_log(spark, d))


_ART = (
    "artifact as (select page_id % 50 as company_id, case when page_id % 7 = 0 then 'robots' else 'page' end as kind,"
    " regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as authority, case when page_id % 14 = 0 then 503 else 200 end as http_status,"
    " case when page_id % 5 <> 0 then sha256(html) end as content_hash from pages)"
)


def _artifacts(spark, d):
    from attesta.functions import urls

    p = table(spark, d, "pages")
    return p.select(
        (F.col("page_id") % 50).alias("company_id"),
        F.when(F.col("page_id") % 7 == 0, "robots").otherwise("page").alias("kind"),
        urls.authority(F.col("url")).alias("authority"),
        F.when(F.col("page_id") % 14 == 0, 503).otherwise(200).alias("http_status"),
        F.when(F.col("page_id") % 5 != 0, F.sha2(F.col("html").cast("binary"), 256)).alias("content_hash"),
    )


@query(
    "coverage_missing",
    f"with {_ART} select company_id, authority, count(*)::bigint as bodies from artifact a where kind <> 'robots' and content_hash is not null"
    " and not exists (select 1 from artifact r where r.kind = 'robots' and r.company_id = a.company_id and r.authority = a.authority) group by company_id, authority",
)
def coverage_missing(spark, d):
    return logs.coverage(_artifacts(spark, d))


@query(
    "coverage_breaches",
    f"with {_ART} select company_id, authority, count(*)::bigint as bodies from artifact a where kind <> 'robots' and content_hash is not null"
    " and exists (select 1 from artifact r where r.kind = 'robots' and r.company_id = a.company_id and r.authority = a.authority and not (r.http_status = 200 and r.content_hash is not null)) group by company_id, authority",
)
def coverage_breaches(spark, d):
    return logs.breaches(_artifacts(spark, d))
