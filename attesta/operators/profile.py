"""Which run to believe, and one wide row an entity.

Of every (company, stage) the believed run is the newest finished, non-aborted one that wrote anything
for the company; it supersedes older runs even where all it wrote was rejected. Only then do rejected
facts (confidence 0) drop out, and the newest fact of each key becomes a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Profile column -> (signal key, value slot). The keys are the fact log's vocabulary.
LINEAGE = {
    "platform": ("platform.detected", "value_text"),
    "legal_form": ("impressum.legal_form", "value_text"),
    "gf_count": ("impressum.gf_count", "value_num"),
    "owner_named": ("impressum.owner_named", "value_num"),
    "impressum_extracted": ("llm.impressum_extracted", "value_num"),
    "homepage_extracted": ("llm.homepage_extracted", "value_num"),
    "product_url_count": ("catalog.product_url_count", "value_num"),
    "product_url_tier": ("catalog.product_url_count", "value_text"),
    "own_brand": ("offer.own_brand", "value_num"),
    "trusted_shops": ("reviews.trusted_shops", "value_num"),
    "review_count": ("reviews.count", "value_num"),
    "blog_exists": ("content.blog_exists", "value_num"),
    "blog_search_exhaustive": ("content.blog_search_exhaustive", "value_num"),
    "blog_search_limit": ("content.blog_search_exhaustive", "value_text"),
    "blog_last_post": ("content.blog_last_post", "value_date"),
    "blog_last_post_basis": ("content.blog_last_post_basis", "value_text"),
    "blog_post_count": ("content.blog_post_count", "value_num"),
    "blog_post_dates": ("content.blog_post_dates", "value_text"),
    "article_schema": ("schema.article_present", "value_num"),
    "product_schema": ("schema.product_present", "value_num"),
    "ai_queries_checked": ("ai.queries_checked", "value_num"),
    "ai_brand_mentions": ("ai.brand_mentions", "value_num"),
    "lighthouse_perf": ("perf.lighthouse_performance", "value_num"),
    "hreflang_count": ("i18n.hreflang_count", "value_num"),
    "agency_credit": ("agency.footer_credit", "value_text"),
}
KEYS = sorted({key for key, _ in LINEAGE.values()})


def observed(signals: DataFrame, runs: DataFrame) -> DataFrame:
    """Facts with their run's stage and end. Runs are a small dimension: Spark broadcasts them where their size allows."""
    return signals.join(runs.select(F.col("id").alias("run_id"), "stage", "finished_at", "aborted_reason"), "run_id")


def believed(facts: DataFrame) -> DataFrame:
    """The facts of the believed run of each (company, stage): one aggregation and a join on the same keys."""
    ended = facts.where(F.col("finished_at").isNotNull() & F.col("aborted_reason").isNull())
    current = ended.groupBy("company_id", "stage").agg(F.max("run_id").alias("run_id"))
    return facts.join(current, ["company_id", "stage", "run_id"])


def newest(facts: DataFrame) -> DataFrame:
    """The last fact of each (company, key), the higher id on a tie."""
    order = Window.partitionBy("company_id", "key").orderBy(F.col("observed_at").desc(), F.col("id").desc())
    return facts.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def latest(signals: DataFrame, runs: DataFrame) -> DataFrame:
    """The facts that a profile is made of."""
    return newest(believed(observed(signals, runs)).where(F.col("confidence") != 0))


def evidence(signals: DataFrame, runs: DataFrame) -> DataFrame:
    """As ``latest`` with rejected facts left in: what a reader is shown."""
    return newest(believed(observed(signals, runs)))


def rejected(signals: DataFrame) -> DataFrame:
    """The newest rejected claim of each (company, key) by id, of any run."""
    order = Window.partitionBy("company_id", "key").orderBy(F.col("id").desc())
    claims = signals.where((F.col("method") == "llm") & (F.col("confidence") == 0))
    return claims.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def unrendered(rejected_: DataFrame, shown: DataFrame) -> DataFrame:
    """Rejected claims whose (company, key) no component shows."""
    return rejected_.join(shown.select("company_id", "key").distinct(), ["company_id", "key"], "left_anti")


def retracted(signals: DataFrame, runs: DataFrame) -> DataFrame:
    """(company, stage, key) that an older good run wrote and the believed one does not."""
    facts = observed(signals, runs).where(F.col("finished_at").isNotNull() & F.col("aborted_reason").isNull())
    now = believed(facts).select("company_id", "stage", "key").distinct()
    return facts.select("company_id", "stage", "key").distinct().join(now, ["company_id", "stage", "key"], "left_anti")


def pivot(companies: DataFrame, facts: DataFrame) -> DataFrame:
    """Every company with one column per ``LINEAGE`` entry, null where nothing was measured.

    Conditional maxima in one aggregation, so a single exchange on the company serves all columns.
    """
    columns = [F.max(F.when(F.col("key") == key, F.col(slot))).alias(name) for name, (key, slot) in LINEAGE.items()]
    wide = facts.groupBy(F.col("company_id").alias("id")).agg(*columns).withColumnRenamed("legal_form", "stated_form")
    joined = companies.join(wide, "id", "left")
    form = F.coalesce("stated_form", "legal_form") if "legal_form" in companies.columns else F.col("stated_form")
    listed = F.when(F.coalesce("blog_post_dates", F.lit("")) == "", F.array().cast("array<date>")).otherwise(F.transform(F.split("blog_post_dates", ","), lambda d: d.cast("date")))
    keep = [c for c in companies.columns if c != "legal_form"]
    return joined.select(*keep, form.alias("legal_form"), *[listed.alias(n) if n == "blog_post_dates" else F.col(n) for n in LINEAGE if n != "legal_form"])


def profile(companies: DataFrame, signals: DataFrame, runs: DataFrame) -> DataFrame:
    return pivot(companies, latest(signals, runs))


def unreachable(inputs: set[str], company_columns: set[str]) -> set[str]:
    """Rule inputs that neither a signal key nor a company column can explain."""
    return inputs - set(LINEAGE) - company_columns
