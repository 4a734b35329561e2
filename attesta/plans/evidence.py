"""Profile, rules, scores, history and review state over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import profile as P
from attesta.operators import review, scoring
from attesta.plans.registry import query
from attesta.sources import adapters as A

_BASE = f"with {A.SIGNAL}, {A.RUN}, {A.ENTITY}, observed as (select s.*, r.stage, r.finished_at, r.aborted_reason from signal s join run r on s.run_id = r.id)"
_BELIEVED = (
    _BASE
    + """, current_run as (select company_id, stage, max(run_id) as run_id from observed where finished_at is not null and aborted_reason is null group by company_id, stage),
believed as (select o.* from observed o join current_run c on o.company_id = c.company_id and o.stage = c.stage and o.run_id = c.run_id)"""
)
_NEWEST = "row_number() over (partition by company_id, key order by observed_at desc, id desc) as rn"
_LATEST = _BELIEVED + f", latest as (select * from (select *, {_NEWEST} from believed where confidence <> 0) x where rn = 1)"
_PIVOT = ", ".join(f"max(case when key = '{k}' then {slot} end) as {name}" for name, (k, slot) in P.LINEAGE.items() if name != "legal_form")
_PROFILE = (
    _LATEST
    + f""", wide as (select company_id, max(case when key = 'impressum.legal_form' then value_text end) as stated_form, {_PIVOT} from latest group by company_id),
profile as (select e.id, e.domain, e.excluded, coalesce(w.stated_form, e.legal_form) as legal_form, w.* exclude (company_id, stated_form, blog_post_dates),
  case when coalesce(w.blog_post_dates, '') = '' then cast([] as date[]) else cast(string_split(w.blog_post_dates, ',') as date[]) end as dates
  from entity e left join wide w on e.id = w.company_id)"""
)
_DAY = f"date '{A.TODAY}'"


def _age(d: str) -> str:
    return f"date_diff('day', {d}, {_DAY})"


# (rule, points, state) in declaration order; ladders in the order of their rungs.
_READ = "coalesce(homepage_extracted = 1, false)"
_BOUND = "coalesce(blog_last_post_basis in ('index', 'both'), false)"
_OLD = f"coalesce({_age('blog_last_post')} > 365, false)"
_HALF = f"coalesce({_age('blog_last_post')} >= 180, false)"
_RECENT = f"len(list_filter(dates, lambda d: date_diff('day', d, {_DAY}) <= 180))"


def _state(fires: str, abstains: str = "false") -> str:
    return f"case when coalesce({fires}, false) then 'fired' when coalesce({abstains}, false) then 'abstained' else 'declined' end"


_STATES = {
    "qual.ecommerce_platform": (15, _state("platform <> ''")),
    "qual.owner_operated": (15, _state("coalesce(legal_form in ('e.K.', 'Einzelunternehmen', 'GbR'), false) or coalesce(gf_count between 1 and 2, false) or coalesce(owner_named = 1, false)", f"owner_named is null and {_READ}")),
    "qual.product_depth": (10, _state("product_url_count >= 20")),
    "qual.own_brand": (10, _state(f"{_READ} and own_brand = 1", f"{_READ} and own_brand is null")),
    "qual.own_domain_shop": (5, _state("product_url_count >= 5")),
    "qual.product_strength": (10, _state("coalesce(trusted_shops = 1, false) or coalesce(review_count >= 50, false)")),
    "opp.no_blog": (25, _state("blog_exists = 0 and coalesce(blog_search_exhaustive = 1, false)", "blog_exists is null or (blog_exists = 0 and not coalesce(blog_search_exhaustive = 1, false))")),
    "opp.blog_stale": (20, _state(f"{_OLD} and {_BOUND}", f"blog_last_post is null or ({_OLD} and not {_BOUND})")),
    "opp.thin_blog": (12, _state("blog_post_count < 10")),
    "opp.blog_slowing": (10, _state(f"{_HALF} and {_BOUND}", f"{_HALF} and not {_BOUND}")),
    "opp.no_article_schema": (8, _state("blog_exists = 1 and article_schema <> 1", "blog_exists = 1 and article_schema is null")),
    "opp.no_product_schema": (10, _state("product_schema <> 1", "product_schema is null")),
    "opp.ai_invisible": (15, _state("ai_queries_checked >= 2 and ai_brand_mentions = 0")),
    "opp.slow_site": (10, _state("lighthouse_perf < 50")),
    "opp.de_only": (5, _state("hreflang_count <= 1", "hreflang_count is null")),
    "neg.has_agency": (-20, _state("trim(coalesce(agency_credit, '')) <> ''")),
    "neg.active_content": (-25, _state(f"blog_exists = 1 and {_RECENT} >= 4", f"blog_exists = 1 and {_RECENT} < 4 and (blog_post_count is null or len(list_distinct(dates)) < blog_post_count)")),
}
_LADDER = ("opp.no_blog", "opp.blog_stale", "opp.thin_blog", "opp.blog_slowing")
_RAW = ", states as (select *, " + ", ".join(f"{s} as s{i}" for i, (_, s) in enumerate(_STATES.values())) + " from profile)"
_names = list(_STATES)


def _final(i: int) -> str:
    if _names[i] in _LADDER and (earlier := _LADDER[: _LADDER.index(_names[i])]):
        met = " or ".join(f"s{_names.index(e)} <> 'declined'" for e in earlier)
        return f"case when {met} then 'declined' else s{i} end"
    return f"s{i}"


_SETTLED = {"qual.owner_operated": f"coalesce(impressum_extracted = 1, false) and {_READ}", "qual.own_brand": _READ, "opp.ai_invisible": "ai_queries_checked is not null", "opp.slow_site": "lighthouse_perf is not null"}
_SCORED = (
    _PROFILE
    + _RAW
    + ", finals as (select *, " + ", ".join(f"{_final(i)} as f{i}" for i in range(len(_names))) + " from states)"
    + ", scored as (select *, cast(" + " + ".join(f"case when f{i} = 'fired' then {p} else 0 end" for i, (p, _) in enumerate(_STATES.values())) + " as integer) as total, cast("
    + " + ".join(f"case when f{_names.index(r)} <> 'fired' and not ({settled}) then {_STATES[r][0]} else 0 end" for r, settled in _SETTLED.items()) + " as integer) as upside from finals)"
)
_BAND = "case when total >= 75 then 'A' when total >= 55 then 'B' when total >= 30 then 'C' else 'D' end"


def _profile(spark, d):
    return P.profile(A.entities(spark, d), A.signals(spark, d), A.runs(spark, d))


def _scored(spark, d):
    return scoring.evaluate(_profile(spark, d), A.TODAY)


@query("ranked_scores", _SCORED + f" select id, domain, total, {_BAND} as band, total + upside >= 55 as admitted, cast({' + '.join(f'''case when f{i} = 'abstained' then 1 else 0 end''' for i in range(len(_names)))} as integer) as abstained from scored where not excluded order by total desc, domain")
def ranked_scores(spark, d):
    kept = _scored(spark, d).where(~F.col("excluded"))
    rows = kept.select("id", "domain", "total", "band", "admitted", F.size(F.filter("components", lambda c: c["state"] == "abstained")).alias("abstained"))
    return scoring.ranked(rows)


_SHOWN = [n for n in P.LINEAGE if n not in ("legal_form", "blog_post_dates")]


@query("profile_pivot", _PROFILE + f" select id, domain, legal_form, {', '.join(_SHOWN)}, cast(len(dates) as integer) as listed_dates from profile")
def profile_pivot(spark, d):
    return _profile(spark, d).select("id", "domain", "legal_form", *_SHOWN, F.size("blog_post_dates").alias("listed_dates"))


_FACT = "company_id, key, id, run_id, confidence, coalesce(nullif(value_text, ''), cast(value_date as varchar), cast(cast(value_num as bigint) as varchar)) as shown"


def _facts(df):
    from attesta.functions.text import evidence

    return df.select("company_id", "key", "id", "run_id", "confidence", evidence(F.col("value_text"), F.col("value_date"), F.col("value_num").cast("bigint")).alias("shown"))


@query("evidence_latest", _BELIEVED + f" select {_FACT} from (select *, {_NEWEST} from believed) x where rn = 1")
def evidence_latest(spark, d):
    return _facts(P.evidence(A.signals(spark, d), A.runs(spark, d)))


@query("rejected_latest", f"with {A.SIGNAL} select {_FACT} from (select *, row_number() over (partition by company_id, key order by id desc) as rn from signal where method = 'llm' and confidence = 0) x where rn = 1")
def rejected_latest(spark, d):
    return _facts(P.rejected(A.signals(spark, d)))


@query(
    "rejected_unrendered",
    _LATEST + ", rejected as (select * from (select *, row_number() over (partition by company_id, key order by id desc) as rn from signal where method = 'llm' and confidence = 0) x where rn = 1)"
    " select company_id, key, id from rejected r where not exists (select 1 from latest l where l.company_id = r.company_id and l.key = r.key)",
)
def rejected_unrendered(spark, d):
    s = A.signals(spark, d)
    return P.unrendered(P.rejected(s), P.latest(s, A.runs(spark, d))).select("company_id", "key", "id")


@query(
    "run_retraction",
    _BELIEVED + " select distinct company_id, stage, key from observed o where finished_at is not null and aborted_reason is null"
    " and not exists (select 1 from believed b where b.company_id = o.company_id and b.stage = o.stage and b.key = o.key)",
)
def run_retraction(spark, d):
    return P.retracted(A.signals(spark, d), A.runs(spark, d))


@query("rule_components", _SCORED + " " + " union all ".join(f"select id as company_id, '{n}' as rule_id, cast(case when f{i} = 'fired' then {p} else 0 end as integer) as points, f{i} as state from scored where f{i} <> 'declined'" for i, (n, (p, _)) in enumerate(_STATES.items())))
def rule_components(spark, d):
    return scoring.component_rows(_scored(spark, d)).select("company_id", "rule_id", "points", "state")


@query("gate_upside", _SCORED + " select id, total, upside, total + upside >= 55 as admitted from scored")
def gate_upside(spark, d):
    return _scored(spark, d).select("id", "total", "upside", "admitted")


_HISTORY = "history as (select user_id as company_id, cast(1 as integer) as phase, event_type as rule_id, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as bigint) as run_id, cast(ts as date) as day, bool_and(event_id % 4 <> 0) as abstained from events group by all)"


@query(
    "persistence_streak",
    f"with {_HISTORY}, s as (select *, sum(case when abstained then 0 else 1 end) over (partition by company_id, phase, rule_id order by run_id desc) as broken from history),"
    " g as (select company_id, phase, rule_id, list_reverse_sort(list_distinct(list(day))) as days from s where broken = 0 group by all)"
    " select company_id, phase, rule_id, len(days)::bigint as days, days[3] as since from g where len(days) >= 3",
)
def persistence_streak(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    day = F.to_date("ts")
    history = e.groupBy(F.col("user_id").alias("company_id"), F.lit(1).alias("phase"), F.col("event_type").alias("rule_id"), F.datediff(day, F.lit("2024-01-01").cast("date")).cast("bigint").alias("run_id"), day.alias("day")).agg(F.bool_and(F.col("event_id") % 4 != 0).alias("abstained"))
    return scoring.abstention_streaks(history)


_SCORES = f"{A.RUN}, score as (select event_id as id, cast(date_diff('day', date '2024-01-01', cast(ts as date)) * 3 + (event_id * 7 + user_id) % 3 as bigint) as run_id, user_id as company_id, cast(event_id % 2 + 1 as integer) as phase, cast(floor(value) as integer) as total from events where event_type in ('view', 'purchase'))"


@query("authoritative_score", f"with {_SCORES} select company_id, phase, run_id, total from (select s.*, row_number() over (partition by company_id order by phase desc, run_id desc, s.id desc) as rn from score s join run r on r.id = s.run_id and r.finished_at is not null) x where rn = 1")
def authoritative_score(spark, d):
    s = A.signals(spark, d).select("id", "run_id", "company_id")
    e = spark.read.parquet(f"{d}/events.parquet").where(F.col("event_type").isin("view", "purchase"))
    scores = e.select(F.col("event_id").alias("id"), (F.col("event_id") % 2 + 1).cast("int").alias("phase"), F.floor("value").cast("int").alias("total")).join(s, "id")
    # A run scores a company once in the engine; here the newest row stands for it.
    once = scores.groupBy("company_id", "run_id", "phase").agg(F.max_by("total", "id").alias("total"))
    return scoring.authoritative(once, A.runs(spark, d)).select("company_id", "phase", "run_id", "total")


_FLAGS = """raised as (select user_id as company_id, event_type as reason, event_id as seq, event_id % 5 = 0 as resolves from events)"""


@query("flags_sticky", f"with {_FLAGS} select company_id, reason, min(seq) as raised_at, max(case when resolves then seq end) as resolved_at, cast(count(*) as bigint) as raises from raised group by company_id, reason")
def flags_sticky(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("company_id"), F.col("event_type").alias("reason"), F.col("event_id").alias("at"), (F.col("event_id") % 5 == 0).alias("resolves"))
    return review.flag_state(e)


@query(
    "derived_blocked",
    f"with {A.ENTITY}, {_FLAGS}, open as (select company_id, reason from raised group by company_id, reason having not bool_or(resolves))"
    " select e.id, exists (select 1 from open o where o.company_id = e.id) as needs_review, exists (select 1 from open o where o.company_id = e.id and o.reason = 'error') as contact_blocked from entity e",
)
def derived_blocked(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("company_id"), F.col("event_type").alias("reason"), F.col("event_id").alias("at"), (F.col("event_id") % 5 == 0).alias("resolves"))
    blocking = spark.createDataFrame([("error",)], "reason string")
    return review.derived(A.entities(spark, d), review.flag_state(e), blocking).select("id", "needs_review", "contact_blocked")


@query(
    "guard_violations",
    f"with {A.ENTITY}, {_FLAGS}, open as (select company_id, reason from raised where reason = 'error' group by company_id, reason having not bool_or(resolves)),"
    " o as (select event_id as id, user_id as company_id, case event_type when 'view' then 'post' when 'click' then 'mail' else 'phone' end as channel from events)"
    " select o.id, case when e.excluded then 'excluded' when exists (select 1 from open b where b.company_id = o.company_id) then 'blocked' when o.channel not in ('post', 'phone') then 'channel' end as violation"
    " from o join entity e on e.id = o.company_id where e.excluded or exists (select 1 from open b where b.company_id = o.company_id) or o.channel not in ('post', 'phone')",
)
def guard_violations(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    e = events.select(F.col("user_id").alias("company_id"), F.col("event_type").alias("reason"), F.col("event_id").alias("at"), (F.col("event_id") % 5 == 0).alias("resolves"))
    companies = review.derived(A.entities(spark, d), review.flag_state(e), spark.createDataFrame([("error",)], "reason string"))
    channel = F.when(F.col("event_type") == "view", "post").when(F.col("event_type") == "click", "mail").otherwise("phone")
    outreach = events.select(F.col("event_id").alias("id"), F.col("user_id").alias("company_id"), channel.alias("channel"))
    return review.outreach_violations(outreach, companies).select("id", "violation")
