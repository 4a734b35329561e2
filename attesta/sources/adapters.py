"""Engine inputs made from the driver's tables. Synthetic: the values mean nothing, the shapes do.

Each adapter is one SQL text for both engines (Spark, and DuckDB in the oracles), with the few
functions that differ filled in, so that a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.operators.profile import KEYS

TODAY = "2026-08-15"

_SPARK = {"k": "cast(get_json_object(props, '$.k') as int)", "day": "datediff(ts, date'2024-01-01')", "back": "date_sub(date'2026-08-15', {})", "midnight": "cast(date_add(date'2024-01-01', {}) as timestamp)"}
_DUCK = {"k": "cast(json_extract_string(props, '$.k') as integer)", "day": "date_diff('day', date '2024-01-01', cast(ts as date))", "back": "date '2026-08-15' - cast({} as integer)", "midnight": "cast(date '2024-01-01' + cast({} as integer) as timestamp)"}

#: Keys whose facts are flags, and those whose facts are dates or lists of dates.
FLAGS = ("impressum.owner_named", "llm.impressum_extracted", "llm.homepage_extracted", "offer.own_brand", "reviews.trusted_shops", "content.blog_exists", "content.blog_search_exhaustive", "schema.article_present", "schema.product_present")


def _case(pairs, other: str) -> str:
    return "case key " + " ".join(f"when '{k}' then {v}" for k, v in pairs) + f" else {other} end"


def signal_sql(fn: dict) -> str:
    keys = "case cast((event_id * 7 + user_id) % {} as int) ".format(len(KEYS)) + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KEYS)) + " end"
    texts = {
        "platform.detected": "case k % 4 when 0 then 'JTL' when 1 then 'Shopify' when 2 then 'Shopware' else '' end",
        "impressum.legal_form": "case k % 5 when 0 then 'e.K.' when 1 then 'GmbH' when 2 then 'GbR' when 3 then 'AG' else 'OHG' end",
        "catalog.product_url_count": "case k % 2 when 0 then 'sitemap' else 'links' end",
        "content.blog_search_exhaustive": "case k % 3 when 0 then 'transient:timeout' when 1 then 'limit:shards' end",
        "content.blog_last_post_basis": "case k % 3 when 0 then 'index' when 1 then 'both' else 'article' end",
        "content.blog_post_dates": "cast({} as string) || ',' || cast({} as string) || ',' || cast({} as string) || ',' || cast({} as string)".format(*(fn["back"].format(f"k * {i} + {i}") for i in (1, 2, 3, 4))),
        "agency.footer_credit": "case k % 3 when 0 then 'Webdesign: Studio ' || cast(k as string) when 1 then ' ' end",
    }
    nums = [(k, "cast(k % 2 as double)") for k in FLAGS] + [("impressum.gf_count", "cast(k % 4 as double)"), ("ai.queries_checked", "cast(k % 4 as double)"), ("ai.brand_mentions", "cast(k % 2 as double)"), ("i18n.hreflang_count", "cast(k % 3 as double)")]
    return f"""
select event_id as id, user_id as company_id, cast(day * 3 + stage_no as bigint) as run_id, key, stage_no,
  {_case(texts.items(), 'cast(null as string)')} as value_text,
  {_case([*nums, *[(k, 'cast(null as double)') for k in ('platform.detected', 'impressum.legal_form', 'content.blog_last_post', 'content.blog_last_post_basis', 'content.blog_post_dates', 'agency.footer_credit')]], 'cast(k as double)')} as value_num,
  case when key = 'content.blog_last_post' then {fn['back'].format('k * 6')} end as value_date,
  case when k % 2 = 0 then 'llm' else 'deterministic' end as method,
  case when k % 10 = 0 then 0.0e0 else 1.0e0 end as confidence, ts as observed_at
from (select *, {keys} as key, cast((event_id * 7 + user_id) % 3 as int) as stage_no from (select event_id, user_id, ts, {fn['k']} as k, {fn['day']} as day from events) e0) e1"""


def run_sql(fn: dict) -> str:
    return f"""
select id, case id % 3 when 0 then 'extract_p1' when 1 then 'extract_p2' else 'pagespeed' end as stage, started_at,
  case when id % 11 <> 0 then started_at end as finished_at, case when id % 7 = 0 then 'ceiling' end as aborted_reason
from (select id, {fn['midnight'].format('id / 3') if fn is _SPARK else fn['midnight'].format('id // 3')} as started_at from (select distinct cast({fn['day']} * 3 + (event_id * 7 + user_id) % 3 as bigint) as id from events) r0) r1"""


COMPANY_SQL = """
select cast(c_custkey as bigint) as id, 'shop' || cast(c_custkey as string) || case n_regionkey when 0 then '.de' when 1 then '.at' when 2 then '.ch' when 3 then '.com' else '.li' end as domain,
  case when c_custkey % 4 = 0 then 'GbR' end as legal_form, c_custkey % 13 = 0 as excluded, c_mktsegment as discovery_source, n_name as city
from customer join nation on c_nationkey = n_nationkey"""
ENTITY_SQL = """
select user_id as id, 'shop' || cast(user_id as string) || '.de' as domain, case when user_id % 4 = 0 then 'GbR' end as legal_form, user_id % 13 = 0 as excluded
from (select distinct user_id from events) u"""


def _run(spark: SparkSession, sf_dir: str, table: str, sql: str, *more: str) -> DataFrame:
    return spark.sql(sql.replace(f"from {table})", f"from {{{table}}})"), **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "events", signal_sql(_SPARK))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "events", run_sql(_SPARK).replace("id / 3", "cast(floor(id / 3) as int)"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "events", ENTITY_SQL)


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation")}
    return spark.sql(COMPANY_SQL.replace("from customer join nation", "from {customer} join {nation}"), **tables)


#: Common tables of the oracles.
SIGNAL, RUN, ENTITY, COMPANY = (f"{n} as ({s})" for n, s in (("signal", signal_sql(_DUCK)), ("run", run_sql(_DUCK)), ("entity", ENTITY_SQL), ("company", COMPANY_SQL)))
