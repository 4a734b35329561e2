"""Three-valued rules as data, compiled to columns.

A rule fires, declines or abstains. It is declared by what it reads, two conditions and texts; ladders are
rules with a common ``chain`` of which only the first that does not decline counts. Nothing here is a
UDF: every rule is one struct expression and the ruleset one array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import dates

# The ruleset's thresholds and version.
VERSION = "v3"
BANDS = (("A", 75), ("B", 55), ("C", 30))
LOWEST_BAND = "D"
ADMITTED_FROM = 55
HALF_YEAR, YEAR = 180, 365
OWNER_FORMS = ("e.K.", "Einzelunternehmen", "GbR")
SECTIONS = ("6.1", "6.2", "6.3")


@dataclass(frozen=True)
class Rule:
    """``fires`` and ``abstains`` are conditions in order of precedence (a null is false); ``abstain_first`` swaps them."""

    id: str
    points: int
    section: str
    reads: tuple[str, ...]
    fires: Column
    reason: Column
    abstains: Column | None = None
    abstain_reason: Column | None = None
    abstain_first: bool = False
    flag: Column | None = None
    persistent: Column | None = None
    reachable: bool = False
    settled: Column | None = None
    chain: str | None = None

    def state(self) -> Column:
        """fired, abstained or declined, by itself."""
        fired = F.when(self.fires, F.lit("fired"))
        abstained = F.when(self.abstains, F.lit("abstained")) if self.abstains is not None else F.lit(None).cast("string")
        order = (abstained, fired) if self.abstain_first else (fired, abstained)
        return F.coalesce(*order, F.lit("declined"))

    def outcome(self, state: Column) -> Column:
        """struct<rule_id, state, points, reason, flag, persistent> for a state that stands in a column."""
        none = F.lit(None).cast("string")

        def given(c):
            return F.when(state == "abstained", c) if c is not None else none

        return F.struct(
            F.lit(self.id).alias("rule_id"),
            state.alias("state"),
            F.when(state == "fired", F.lit(self.points)).otherwise(F.lit(0)).alias("points"),
            F.when(state == "fired", self.reason).otherwise(given(self.abstain_reason)).alias("reason"),
            given(self.flag).alias("flag"),
            given(self.persistent).alias("persistent"),
        )


def validate(rules: list[Rule]) -> None:
    """Unique ids, points other than 0, something read, a known section, settled exactly where reachable."""
    ids = [r.id for r in rules]
    for r in rules:
        if ids.count(r.id) > 1:
            raise ValueError(f"{r.id} is declared twice")
        if not r.points:
            raise ValueError(f"{r.id} is worth nothing")
        if not r.reads:
            raise ValueError(f"{r.id} reads nothing")
        if r.section not in SECTIONS:
            raise ValueError(f"{r.id} is of section {r.section}")
        if r.reachable != (r.settled is not None):
            raise ValueError(f"{r.id} must say when it is settled exactly if phase 2 can reach it")


def inputs(rules: list[Rule]) -> set[str]:
    return {name for r in rules for name in r.reads}


def _is(name: str, value: float) -> Column:
    return F.coalesce(F.col(name) == value, F.lit(False))


def _text(pattern: str, *values) -> Column:
    return F.format_string(pattern, *values)


def _int(name: str) -> Column:
    return F.col(name).cast("long")


def registry(today: Column) -> list[Rule]:
    """The ruleset; ``today`` is an input of the evaluation, never the clock."""
    col, lit = F.col, F.lit
    homepage_read, impressum_read = _is("homepage_extracted", 1), _is("impressum_extracted", 1)
    none = lit(None).cast("string")
    searched = _is("blog_search_exhaustive", 1)
    transient = F.coalesce(col("blog_search_limit").startswith("transient:"), lit(False))
    bounded = F.coalesce(col("blog_last_post_basis").isin("index", "both"), lit(False))
    age = F.datediff(today, col("blog_last_post"))
    newest = dates.month_year(col("blog_last_post"))
    recent = F.size(F.filter("blog_post_dates", lambda d: F.datediff(today, d) <= HALF_YEAR))
    listed = F.size(F.array_distinct("blog_post_dates"))
    credit = F.trim(F.coalesce("agency_credit", lit("")))
    owner = F.coalesce(col("legal_form").isin(*OWNER_FORMS), lit(False)) | F.coalesce(col("gf_count").between(1, 2), lit(False)) | _is("owner_named", 1)
    no_blog_known = col("blog_exists").isNull() | (_is("blog_exists", 0) & ~searched)
    sampled = F.concat(lit("Nicht bewertbar: Der Stand "), newest, lit(" ist nur durch eine Stichprobe belegt."))
    cadence = F.when(
        col("blog_post_count").isNull(), _text("Nicht bewertbar: Die Zahl der Beiträge ist unbekannt, %d sind datiert.", listed)
    ).otherwise(_text("Nicht bewertbar: %d von %d Beiträgen sind datiert.", listed, _int("blog_post_count")))
    fetch = lit("fetch_failing")
    return [
        Rule("qual.ecommerce_platform", 15, "6.1", ("platform",), F.coalesce(col("platform") != "", lit(False)), F.concat(lit("Shopsystem: "), col("platform"))),
        Rule("qual.owner_operated", 15, "6.1", ("legal_form", "gf_count", "owner_named", "homepage_extracted"), owner, lit("Inhabergeführt."),
             col("owner_named").isNull() & homepage_read, lit("Nicht bewertbar: Die Startseite nennt niemanden."), flag=lit("owner_named_undetermined"), reachable=True, settled=impressum_read & homepage_read),
        Rule("qual.product_depth", 10, "6.1", ("product_url_count",), col("product_url_count") >= 20, _text("Sortiment: %d Produktseiten.", _int("product_url_count"))),
        Rule("qual.own_brand", 10, "6.1", ("own_brand", "homepage_extracted"), homepage_read & _is("own_brand", 1), lit("Eigene Marke."),
             homepage_read & col("own_brand").isNull(), lit("Nicht bewertbar: Ob es eine eigene Marke gibt, bleibt offen."), flag=lit("own_brand_undetermined"), reachable=True, settled=homepage_read),
        Rule("qual.own_domain_shop", 5, "6.1", ("product_url_count",), col("product_url_count") >= 5, lit("Shop unter eigener Domain.")),
        Rule("qual.product_strength", 10, "6.1", ("trusted_shops", "review_count"), _is("trusted_shops", 1) | F.coalesce(col("review_count") >= 50, lit(False)), lit("Kundenbewertungen sind sichtbar.")),
        Rule("opp.no_blog", 25, "6.2", ("blog_exists", "blog_search_exhaustive", "blog_search_limit"), _is("blog_exists", 0) & searched, lit("Es gibt keinen Blog."),
             no_blog_known, lit("Nicht bewertbar: Die Suche nach einem Blog blieb unvollständig."), flag=F.when(transient, none).otherwise(lit("blog_undetectable")), persistent=F.when(transient, fetch), chain="blog"),
        Rule("opp.blog_stale", 20, "6.2", ("blog_last_post", "blog_last_post_basis"), (age > YEAR) & bounded, F.concat(lit("Zuletzt erschien "), newest, _text(" ein Beitrag, vor %d Monaten.", dates.months_since(col("blog_last_post"), today))),
             col("blog_last_post").isNull() | ((age > YEAR) & ~bounded), F.when(col("blog_last_post").isNull(), lit("Nicht bewertbar: Kein Beitrag ist datiert.")).otherwise(sampled),
             flag=F.when(col("blog_last_post").isNull(), lit("blog_date_unparseable")).otherwise(lit("blog_date_unbounded")), chain="blog"),
        Rule("opp.thin_blog", 12, "6.2", ("blog_post_count",), col("blog_post_count") < 10, _text("Der Blog hat %d Beiträge.", _int("blog_post_count")), chain="blog"),
        Rule("opp.blog_slowing", 10, "6.2", ("blog_last_post", "blog_last_post_basis"), (age >= HALF_YEAR) & bounded, F.concat(lit("Der letzte Beitrag ist von "), newest, lit(".")),
             (age >= HALF_YEAR) & ~bounded, sampled, flag=lit("blog_date_unbounded"), chain="blog"),
        Rule("opp.no_article_schema", 8, "6.2", ("blog_exists", "article_schema"), _is("blog_exists", 1) & (col("article_schema") != 1), lit("Beiträge sind nicht ausgezeichnet."),
             _is("blog_exists", 1) & col("article_schema").isNull(), lit("Nicht bewertbar: Kein Beitrag wurde gelesen."), persistent=fetch),
        Rule("opp.no_product_schema", 10, "6.2", ("product_schema",), col("product_schema") != 1, lit("Produkte sind nicht ausgezeichnet."), col("product_schema").isNull(), lit("Nicht bewertbar: Keine Produktseite wurde gelesen."), persistent=fetch),
        Rule("opp.ai_invisible", 15, "6.2", ("ai_queries_checked", "ai_brand_mentions"), (col("ai_queries_checked") >= 2) & _is("ai_brand_mentions", 0), _text("In %d Antworten kommt die Marke nicht vor.", _int("ai_queries_checked")), reachable=True, settled=col("ai_queries_checked").isNotNull()),
        Rule("opp.slow_site", 10, "6.2", ("lighthouse_perf",), col("lighthouse_perf") < 50, _text("Ladezeit: %d von 100 Punkten.", _int("lighthouse_perf")), reachable=True, settled=col("lighthouse_perf").isNotNull()),
        Rule("opp.de_only", 5, "6.2", ("hreflang_count",), col("hreflang_count") <= 1, lit("Nur eine Sprache."), col("hreflang_count").isNull(), lit("Nicht bewertbar: Sprachen unbekannt.")),
        Rule("neg.has_agency", -20, "6.3", ("agency_credit",), credit != "", F.concat(lit("Betreut von: "), F.substring(credit, 1, 60)), reachable=True, settled=homepage_read),
        Rule("neg.active_content", -25, "6.3", ("blog_exists", "blog_search_exhaustive", "blog_post_dates", "blog_post_count"), _is("blog_exists", 1) & (recent >= 4), _text("%d Beiträge in einem halben Jahr.", recent),
             _is("blog_exists", 1) & (recent < 4) & (col("blog_post_count").isNull() | (listed < col("blog_post_count"))), cadence, flag=lit("blog_cadence_unmeasurable")),
    ]
