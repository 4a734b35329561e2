"""Request-log analytics: spacing per host, hosts in flight, robots coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_INTERVAL, TOLERANCE = 1.0, 0.02


def spacing(log: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """Per host: requests, least gap between consecutive ones (null for one), the gap owed, and whether it was kept.

    ``log``: host, issued (seconds). ``intervals``: host, owed; ``DEFAULT_INTERVAL`` where there is none.
    """
    gap = F.col("issued") - F.lag("issued").over(Window.partitionBy("host").orderBy("issued"))
    gaps = log.withColumn("gap", gap).groupBy("host").agg(F.count("*").alias("requests"), F.min("gap").alias("min_gap"))
    gaps = gaps.join(intervals.select("host", "owed"), "host", "left") if intervals is not None else gaps.withColumn("owed", F.lit(None).cast("double"))
    owed = F.coalesce("owed", F.lit(DEFAULT_INTERVAL))
    return gaps.withColumn("owed", owed).withColumn("kept", F.col("min_gap").isNull() | (F.col("min_gap") >= F.col("owed") - TOLERANCE))


def busy_spans(log: DataFrame) -> DataFrame:
    """(host, start, end): each host's overlapping requests merged into spans. Requests of no duration are left out."""
    real = log.where("elapsed > 0").select("host", F.col("issued").alias("start"), (F.col("issued") + F.col("elapsed")).alias("end"))
    order = Window.partitionBy("host").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reached.isNull() | (F.col("start") >= reached)).cast("int")
    marked = real.withColumn("fresh", fresh)
    span = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("span", span).groupBy("host", "span").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("span")


def most_in_flight(log: DataFrame, slot: float = 86_400.0) -> DataFrame:
    """The largest number of hosts with a request under way at one time; one that ends as another begins does not overlap it.

    Spans are cut at multiples of ``slot`` seconds, so that the sweep runs over many slots at once
    instead of one sorted log.
    """
    spans = busy_spans(log)
    slots = F.sequence(F.floor(F.col("start") / slot), F.greatest(F.floor(F.col("start") / slot), F.ceil(F.col("end") / slot) - 1))
    cut = spans.withColumn("slot", F.explode(slots))
    start, end = F.greatest("start", F.col("slot") * slot), F.least("end", (F.col("slot") + 1) * slot)
    steps = cut.select("slot", F.explode(F.array(F.struct(start.alias("at"), F.lit(1).alias("d")), F.struct(end.alias("at"), F.lit(-1).alias("d")))).alias("p")).select("slot", "p.*")
    live = F.sum("d").over(Window.partitionBy("slot").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return steps.withColumn("live", live).agg(F.coalesce(F.max("live"), F.lit(0)).cast("bigint").alias("max_in_flight"))


def coverage(artifacts: DataFrame) -> DataFrame:
    """(company_id, authority) with stored bodies and no robots row at all, and how many bodies."""
    bodies = artifacts.where("kind <> 'robots' and content_hash is not null")
    robots = artifacts.where("kind = 'robots'").select("company_id", "authority").distinct()
    return bodies.join(robots, ["company_id", "authority"], "left_anti").groupBy("company_id", "authority").agg(F.count("*").alias("bodies"))


def breaches(artifacts: DataFrame) -> DataFrame:
    """Bodies fetched under an authority whose robots row is not a stored 200."""
    bad = artifacts.where("kind = 'robots' and not (http_status = 200 and content_hash is not null)").select("company_id", "authority").distinct()
    bodies = artifacts.where("kind <> 'robots' and content_hash is not null")
    return bodies.join(bad, ["company_id", "authority"]).groupBy("company_id", "authority").agg(F.count("*").alias("bodies"))


def failing_days(artifacts: DataFrame, fetch_days: DataFrame) -> DataFrame:
    """(company_id, authority, days): fetch days since robots first failed with no success after."""
    robots = artifacts.where("kind = 'robots'").withColumn("good", F.coalesce((F.col("http_status") == 200) & F.col("content_hash").isNotNull(), F.lit(False)))
    ends = robots.groupBy("company_id", "authority").agg(F.max(F.when(F.col("good"), F.col("fetched_at"))).alias("good_at"))
    since = robots.where("not good").join(ends, ["company_id", "authority"]).where("good_at is null or fetched_at > good_at").groupBy("company_id", "authority").agg(F.min("fetched_at").alias("since"))
    days = fetch_days.join(since, "company_id").where("started_at >= since").groupBy("company_id", "authority").agg(F.count_distinct(F.to_date("started_at")).alias("days"))
    return days


def verdict(spaced: DataFrame, in_flight: DataFrame, uncovered: DataFrame, ceiling: int = 2) -> DataFrame:
    """One row ``ok``: every host kept its gap, the ceiling held, nothing is uncovered - and something was logged."""
    a = spaced.agg(F.coalesce(F.bool_and("kept"), F.lit(False)).alias("gaps"))
    b = in_flight.select((F.col("max_in_flight") <= ceiling).alias("flight"))
    c = uncovered.agg((F.count("*") == 0).alias("covered"))
    return a.join(b).join(c).select((F.col("gaps") & F.col("flight") & F.col("covered")).alias("ok"))  # one row each
