"""The budget ledger: rolling spend, ceilings, prices, estimates corrected by actual cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The default ceilings in dollars, the window in days, the price of a web search.
WINDOW_DAYS, WINDOW_CEILING, RUN_CEILING = 30, 45.0, 5.0
SEARCH_PRICE = 0.01


def spent(ledger: DataFrame, now: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """The sum of ``amount`` at ``at`` within the window that ends now; 0 for none."""
    return ledger.where((F.col("at") > now - F.make_interval(days=F.lit(days))) & (F.col("at") <= now)).agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("spent"))


def rolling(daily: DataFrame, days: int = WINDOW_DAYS, ceiling: float = WINDOW_CEILING) -> DataFrame:
    """(account, day, amount) with one row a day -> with the spend of the window ending that day, and whether it is over the ceiling."""
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    window = Window.partitionBy("account").orderBy(number).rangeBetween(-(days - 1), 0)
    return daily.withColumn("spent", F.sum("amount").over(window)).withColumn("refused", F.col("spent") > ceiling)


def run_ceiling(charges: DataFrame, ceiling: float = RUN_CEILING) -> DataFrame:
    """(run_id, seq, amount) -> the total after each charge and whether that charge is refused."""
    total = F.sum("amount").over(Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return charges.withColumn("total", total).withColumn("refused", F.col("total") > ceiling)


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, batch, input_tokens, output_tokens, searches) with its cost; a model without a price is an error."""
    found = calls.join(prices.select("model", "batch", "input_per_mtok", "output_per_mtok"), ["model", "batch"], "left")
    checked = F.when(F.col("input_per_mtok").isNull(), F.raise_error(F.concat(F.lit("no price for "), "model")).cast("double")).otherwise(F.col("input_per_mtok"))
    return found.withColumn("cost", estimate(F.col("input_tokens"), F.col("output_tokens"), checked, F.col("output_per_mtok"), F.col("searches"))).drop("input_per_mtok", "output_per_mtok")


def estimate(input_tokens: Column, output_tokens: Column, input_per_mtok: Column, output_per_mtok: Column, searches: Column) -> Column:
    return input_tokens / 1e6 * input_per_mtok + output_tokens / 1e6 * output_per_mtok + searches * SEARCH_PRICE


def corrections(batches: DataFrame) -> DataFrame:
    """(run_id, delta): at close, actual less estimated cost of each batch, on the run that submitted it."""
    closed = batches.where("reconciled_at is not null and actual_cost_usd is not null")
    return closed.groupBy("run_id").agg(F.sum(F.col("actual_cost_usd") - F.col("est_cost_usd")).alias("delta"))


def run_totals(events: DataFrame) -> DataFrame:
    """Summed ledger events of each run; a total below zero is an error."""
    total = events.groupBy("run_id").agg(F.sum("amount").alias("total"))
    return total.withColumn("total", F.when(F.col("total") < -1e-9, F.raise_error(F.concat(F.lit("negative total of run "), F.col("run_id").cast("string"))).cast("double")).otherwise(F.col("total")))
