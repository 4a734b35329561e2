"""Lists, ledgers, batches, diffs and retention over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import batches, ledger, listing, review, snapshots, writes
from attesta.plans.registry import query, table
from attesta.sources import adapters as A

NOW = "1998-06-30"


@query("faceted_list", f"with {A.COMPANY} select id, domain, city from company where not excluded and discovery_source = 'BUILDING' and city in ('NATION_7', 'NATION_10') union all select id, domain, city from company where excluded and city = 'NATION_2'")
def faceted_list(spark, d):
    c = A.companies(spark, d)
    kept = listing.faceted(c, excluded="no", discovery_source="BUILDING", city="").where(F.col("city").isin("NATION_7", "NATION_10"))
    return kept.select("id", "domain", "city").unionByName(listing.faceted(c, excluded="yes", city="NATION_2").select("id", "domain", "city"))


@query("facets", f"with {A.COMPANY} select 'city' as facet, city as value, count(*)::bigint as n from company group by city union all select 'discovery_source', discovery_source, count(*)::bigint from company group by discovery_source union all select 'legal_form', legal_form, count(*)::bigint from company where legal_form is not null group by legal_form")
def facets(spark, d):
    return listing.facets(A.companies(spark, d), "city", "discovery_source", "legal_form")


@query("status_counts", f"with {A.COMPANY} select legal_form, count(*)::bigint as n from company group by legal_form")
def status_counts(spark, d):
    return listing.counts(A.companies(spark, d), "legal_form")


@query("coverage_counts", "select count(distinct o_custkey)::bigint as entities, count(distinct case when o_orderstatus = 'F' then o_custkey end)::bigint as finished, count(distinct case when o_totalprice > 200000 then o_custkey end)::bigint as large, count(distinct case when o_orderpriority like '1%' then o_custkey end)::bigint as urgent from orders")
def coverage_counts(spark, d):
    return listing.coverage(table(spark, d, "orders"), "o_custkey", finished=F.col("o_orderstatus") == "F", large=F.col("o_totalprice") > 200000, urgent=F.col("o_orderpriority").startswith("1"))


@query(
    "rolling_spend",
    "with daily as (select o_custkey as account, cast(o_orderdate as date) as day, sum(o_totalprice) as amount from orders group by all)"
    " select account, day, round(amount, 2) as amount, round(sum(amount) over w, 2) as spent, sum(amount) over w > 300000 as refused from daily window w as (partition by account order by day range between interval 29 days preceding and current row)",
)
def rolling_spend(spark, d):
    daily = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("account"), F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("amount"))
    return ledger.rolling(daily, ceiling=300_000.0).select("account", "day", F.round("amount", 2).alias("amount"), F.round("spent", 2).alias("spent"), "refused")


@query("spent_now", f"select round(coalesce(sum(o_totalprice), 0), 2) as spent from orders where o_orderdate > timestamp '{NOW}' - interval 30 day and o_orderdate <= timestamp '{NOW}'")
def spent_now(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("amount"))
    return ledger.spent(rows, F.lit(NOW).cast("timestamp")).select(F.round("spent", 2).alias("spent"))


@query("run_ceiling", "select o_custkey as run_id, o_orderkey as seq, round(sum(o_totalprice) over w, 2) as total, sum(o_totalprice) over w > 500000 as refused from orders window w as (partition by o_custkey order by o_orderkey rows unbounded preceding)")
def run_ceiling(spark, d):
    charges = table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("amount"))
    return ledger.run_ceiling(charges, 500_000.0).select("run_id", "seq", F.round("total", 2).alias("total"), "refused")


_CALL = "case when l_returnflag = 'R' then 'large' when l_returnflag = 'A' then 'small' else 'medium' end"


@query(
    "cost_estimate",
    f"with price(model, batch, i, o) as (values ('small', true, 0.5, 2.5), ('small', false, 1.0, 5.0), ('medium', true, 1.5, 7.5), ('medium', false, 3.0, 15.0), ('large', true, 2.5, 12.5), ('large', false, 5.0, 25.0)),"
    f" calls as (select {_CALL} as model, l_linestatus = 'F' as batch, l_quantity * 1000 as it, l_extendedprice as ot, l_linenumber as s from lineitem)"
    " select c.model, c.batch, count(*)::bigint as calls, round(sum(it / 1e6 * i + ot / 1e6 * o + s * 0.01), 4) as cost from calls c join price p on c.model = p.model and c.batch = p.batch group by c.model, c.batch",
)
def cost_estimate(spark, d):
    prices = spark.createDataFrame([("small", True, 0.5, 2.5), ("small", False, 1.0, 5.0), ("medium", True, 1.5, 7.5), ("medium", False, 3.0, 15.0), ("large", True, 2.5, 12.5), ("large", False, 5.0, 25.0)], "model string, batch boolean, input_per_mtok double, output_per_mtok double")
    li = table(spark, d, "lineitem")
    model = F.when(F.col("l_returnflag") == "R", "large").when(F.col("l_returnflag") == "A", "small").otherwise("medium")
    calls = li.select(model.alias("model"), (F.col("l_linestatus") == "F").alias("batch"), (F.col("l_quantity") * 1000).alias("input_tokens"), F.col("l_extendedprice").alias("output_tokens"), F.col("l_linenumber").alias("searches"))
    return ledger.priced(calls, prices).groupBy("model", "batch").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 4).alias("cost"))


@query("cost_corrections", "select o_custkey as run_id, round(sum(o_totalprice - o_totalprice * 0.9), 4) as delta from orders where o_orderstatus = 'F' group by o_custkey")
def cost_corrections(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_custkey").alias("run_id"), (F.col("o_totalprice") * 0.9).alias("est_cost_usd"), F.col("o_totalprice").alias("actual_cost_usd"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("reconciled_at"))
    return ledger.corrections(rows).select("run_id", F.round("delta", 4).alias("delta"))


_ITEM = "case when (l_partkey + l_orderkey) % 97 = 0 then 'balance_exhausted' when l_partkey % 53 = 0 then 'expired' when l_partkey % 31 = 0 then 'server_error' else 'succeeded' end"
_BATCH = f"expected as (select l_orderkey as batch_id, l_linenumber as custom_id from lineitem), items as (select l_orderkey as batch_id, l_linenumber as custom_id, {_ITEM} as outcome from lineitem where l_orderkey % 10 <> 0 and (l_orderkey + l_linenumber) % 12 <> 0)"


def _batches(spark, d):
    li = table(spark, d, "lineitem")
    expected = li.select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("custom_id"))
    outcome = F.when((F.col("l_partkey") + F.col("l_orderkey")) % 97 == 0, "balance_exhausted").when(F.col("l_partkey") % 53 == 0, "expired").when(F.col("l_partkey") % 31 == 0, "server_error").otherwise("succeeded")
    items = li.where("l_orderkey % 10 <> 0 and (l_orderkey + l_linenumber) % 12 <> 0").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("custom_id"), outcome.alias("outcome"))
    # An order may hold a line number twice; an id stands once in a batch.
    return expected.distinct(), items.groupBy("batch_id", "custom_id").agg(F.min("outcome").alias("outcome"))


@query(
    "batch_status",
    f"with {_BATCH}, e as (select distinct * from expected), i as (select batch_id, custom_id, min(outcome) as outcome from items group by all),"
    " f as (select e.batch_id, count(i.outcome) as back, count(*) as n, coalesce(bool_or(i.outcome = 'balance_exhausted'), false) as b, coalesce(bool_or(i.outcome = 'expired'), false) as x, coalesce(bool_or(i.outcome = 'server_error'), false) as s"
    " from e left join i on e.batch_id = i.batch_id and e.custom_id = i.custom_id group by e.batch_id)"
    " select batch_id, case when back = 0 then 'submitted' when b then 'balance_exhausted' when back < n then 'completed' when x then 'expired' when s then 'failed' else 'reconciled' end as status from f",
)
def batch_status(spark, d):
    return batches.status(*_batches(spark, d))


@query("resubmittable", f"with {_BATCH} select batch_id, custom_id, min(outcome) as outcome from items group by all having min(outcome) in ('server_error', 'expired')")
def resubmittable(spark, d):
    return batches.resubmittable(_batches(spark, d)[1])


_GATE = "gate as (select o_custkey as company_id, o_orderkey as run_id, o_totalprice > 120000 as admitted from orders)"


@query(
    "eligibility",
    f"with {A.COMPANY}, {_GATE}, last as (select company_id, arg_max(admitted, run_id) as admitted from gate group by company_id)"
    " select c.id, case when excluded then 'excluded' when admitted is null then 'unscored' when not admitted then 'stopped' else 'admitted' end as verdict from company c left join last l on l.company_id = c.id",
)
def eligibility(spark, d):
    gate = table(spark, d, "orders").select(F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("run_id"), (F.col("o_totalprice") > 120000).alias("admitted"))
    return batches.eligibility(A.companies(spark, d), gate)


@query(
    "budget_topk",
    f"with {A.COMPANY}, {_GATE}, t as (select o_custkey as id, max(o_totalprice) as total from orders group by o_custkey)"
    " select c.id, c.domain, round(t.total, 2) as total, row_number() over (order by t.total is null, t.total desc, c.domain)::integer as rank from company c left join t on t.id = c.id where not c.excluded order by t.total is null, t.total desc, c.domain limit 50",
)
def budget_topk(spark, d):
    total = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("total"))
    rows = A.companies(spark, d).where(~F.col("excluded")).join(total, "id", "left")
    return batches.within_budget(rows, 50).select("id", "domain", F.round("total", 2).alias("total"), "rank")


@query("cache_plan", f"with {A.COMPANY} select c.id, case when max(o_orderdate) > timestamp '{NOW}' - interval 30 day then 'cached' else 'measure' end as plan from company c left join orders on o_custkey = c.id and o_orderdate <= timestamp '{NOW}' group by c.id")
def cache_plan(spark, d):
    now = F.lit(NOW).cast("timestamp")
    measured = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("at")).where(F.col("at") <= now)
    return batches.cache_plan(A.companies(spark, d), measured, now)


_SNAP = "s{n} as (select l_orderkey, string_agg(distinct l_returnflag, '; ' order by l_returnflag) as value from lineitem where l_linenumber {c} group by l_orderkey)"


@query(
    "snapshot_diff",
    f"with {_SNAP.format(n=1, c='in (1, 2)')}, {_SNAP.format(n=2, c='in (2, 3)')}"
    " select coalesce(a.l_orderkey, b.l_orderkey) as l_orderkey, a.value as before, b.value as after, case when a.value is null then 'appeared' when b.value is null then 'disappeared' else 'changed' end as change"
    " from s1 a full outer join s2 b on a.l_orderkey = b.l_orderkey where a.value is distinct from b.value",
)
def snapshot_diff(spark, d):
    li = table(spark, d, "lineitem")
    one, two = (snapshots.snapshot(li.where(F.col("l_linenumber").isin(*n)), ["l_orderkey"], "l_returnflag") for n in ((1, 2), (2, 3)))
    return snapshots.diff(one, two, ["l_orderkey"])


@query("diff_summary", f"select change, count(*)::bigint as n from ({{}}) x group by change")
def diff_summary(spark, d):
    return snapshots.summary(snapshot_diff(spark, d))


@query("retention_purge", f"select o_orderkey, cast(o_orderdate as date) as collected from orders where o_orderdate + interval 12 month >= timestamp '{NOW}' or o_orderstatus = 'O'")
def retention_purge(spark, d):
    o = table(spark, d, "orders")
    limit = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.make_interval(months=F.lit(12)))
    return review.purged(o.withColumn("purge_after", limit), F.lit(NOW).cast("timestamp")).select("o_orderkey", F.to_date("o_orderdate").alias("collected"))


@query("insert_if_absent", "select c_nationkey, c_mktsegment, min(c_custkey) as c_custkey from customer group by all")
def insert_if_absent(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_custkey")
    # The later customers arrive where the earlier ones already are; wherever the cut is, the first of each key stays.
    half = F.lit(750)
    return writes.insert_if_absent(writes.first_of(c.where(F.col("c_custkey") <= half), ["c_nationkey", "c_mktsegment"], ["c_custkey"]), c.where(F.col("c_custkey") > half), ["c_nationkey", "c_mktsegment"], ["c_custkey"])


@query("fill_if_null", f"with {A.COMPANY} select id, coalesce(legal_form, case when id % 3 = 0 then 'GmbH' end) as legal_form from company")
def fill_if_null(spark, d):
    c = A.companies(spark, d).select("id", "legal_form")
    offered = c.select("id", F.when(F.col("id") % 3 == 0, "GmbH").otherwise("AG").alias("legal_form"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.0).alias("confidence"))
    return writes.fill_if_null(c, offered, ["id"], ["legal_form"])


@query("upsert_latest", "select o_custkey, arg_max(o_orderkey, o_orderkey) as o_orderkey, arg_max(o_orderstatus, o_orderkey) as o_orderstatus from orders group by o_custkey")
def upsert_latest(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return writes.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


@query("counter_increments", "select o_custkey, sum(case when o_orderstatus = 'F' then 1 else 0 end)::bigint as n from orders group by o_custkey")
def counter_increments(spark, d):
    return writes.counters(table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", 1).alias("n")), ["o_custkey"])


from attesta.plans.registry import ORACLES  # noqa: E402

ORACLES["diff_summary"] = ORACLES["diff_summary"].format(ORACLES["snapshot_diff"])
