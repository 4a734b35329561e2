"""Scores from profiles: components, total, band, admission gate, persistence of abstentions, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators import rules as R

PERSISTENT_DAYS = 3


def band(total: Column) -> Column:
    out = F.lit(R.LOWEST_BAND)
    for name, floor in reversed(R.BANDS):
        out = F.when(total >= floor, F.lit(name)).otherwise(out)
    return out


def settled_states(ruleset: list[R.Rule], states: list[Column]) -> list[Column]:
    """The rules' own ``states`` with ladders applied: what follows the first of a ladder that does not decline declines."""
    found: list[Column] = []
    met: dict[str, Column] = {}
    for r, state in zip(ruleset, states, strict=True):
        found.append(F.when(met[r.chain], F.lit("declined")).otherwise(state) if r.chain in met else state)
        if r.chain:
            met[r.chain] = met.get(r.chain, F.lit(False)) | (state != "declined")
    return found


def evaluate(profiles: DataFrame, today: str, ruleset: list[R.Rule] | None = None) -> DataFrame:
    """``profiles`` with components (fired and abstained outcomes), total, band, upside, admitted, evaluated_on.

    ``today`` is stored with the score and required. Projections only, no exchange and no UDF: states become
    columns first and everything else reads those.
    """
    if not today:
        raise ValueError("a score needs the date it is evaluated on")
    day = F.lit(today).cast("date")
    ruleset = R.registry(day) if ruleset is None else ruleset
    R.validate(ruleset)
    mark = "state"
    while any(c.lower().startswith(mark) for c in profiles.columns):
        mark += "_"
    own, final = ([f"{mark}{kind}{i}" for i in range(len(ruleset))] for kind in ("own", "final"))
    scored = profiles.select("*", *[r.state().alias(n) for r, n in zip(ruleset, own, strict=True)])
    scored = scored.select("*", *[s.alias(n) for s, n in zip(settled_states(ruleset, [F.col(n) for n in own]), final, strict=True)])
    fired = [F.col(n) == "fired" for n in final]
    total = sum((F.when(f, F.lit(r.points)).otherwise(0) for f, r in zip(fired, ruleset, strict=True)), F.lit(0))
    upside = sum((F.when(~f & ~F.coalesce(r.settled, F.lit(False)), F.lit(r.points)).otherwise(0) for f, r in zip(fired, ruleset, strict=True) if r.reachable and r.points > 0), F.lit(0))
    kept = F.array_compact(F.array(*[F.when(F.col(n) != "declined", r.outcome(F.col(n))) for r, n in zip(ruleset, final, strict=True)]))
    scored = scored.select("*", kept.alias("components"), total.alias("total"), upside.alias("upside")).drop(*own, *final)
    return scored.withColumn("band", band(F.col("total"))).withColumn("admitted", F.col("total") + F.col("upside") >= R.ADMITTED_FROM).withColumn("evaluated_on", day)


def component_rows(scored: DataFrame) -> DataFrame:
    """company, position, rule, points, reason; an abstention has 0 points and a reason."""
    return scored.select(F.col("id").alias("company_id"), F.posexplode("components").alias("position", "c")).select("company_id", "position", "c.rule_id", "c.points", "c.reason", "c.state")


def ranked(scored: DataFrame) -> DataFrame:
    """Unscored last, best first, then by domain."""
    return scored.orderBy(F.col("total").isNull(), F.col("total").desc(), F.col("domain"))


def authoritative(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """The score that counts for each company: of finished runs the highest phase, then the newest run."""
    finished = runs.where("finished_at is not null").select(F.col("id").alias("run_id"))
    order = Window.partitionBy("company_id").orderBy(F.col("phase").desc(), F.col("run_id").desc())
    return scores.join(finished, "run_id").withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def abstention_streaks(history: DataFrame) -> DataFrame:
    """(company, phase, rule) abstained in the newest runs without a break on ``PERSISTENT_DAYS`` distinct days or more.

    ``history``: company_id, phase, rule_id, run_id, day, abstained (whether the rule abstained in that
    run). Newest run first, a streak ends at the first run in which the rule did not abstain; ``since``
    is the earliest of the last three distinct days.
    """
    newest_first = Window.partitionBy("company_id", "phase", "rule_id").orderBy(F.col("run_id").desc())
    broken = F.sum((~F.col("abstained")).cast("int")).over(newest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    days = history.withColumn("broken", broken).where("broken = 0").groupBy("company_id", "phase", "rule_id").agg(F.sort_array(F.collect_set("day"), asc=False).alias("days"))
    return days.where(F.size("days") >= PERSISTENT_DAYS).select("company_id", "phase", "rule_id", F.size("days").cast("long").alias("days"), F.get("days", F.lit(PERSISTENT_DAYS - 1)).alias("since"))


def hook(components: Column) -> Column:
    """The reason of the most valuable opportunity, the first on a tie."""
    chances = F.filter(components, lambda c: c["rule_id"].startswith("opp.") & (c["points"] > 0))
    return F.get(F.filter(chances, lambda c: c["points"] == F.array_max(F.transform(chances, lambda o: o["points"]))), 0)["reason"]


def findings(components: Column) -> Column:
    """struct of opportunities, strengths (then negatives) and, each behind its rule's id, unmeasurable reasons."""
    def reasons(keep) -> Column:
        return F.transform(F.filter(components, keep), lambda c: c["reason"])

    return F.struct(
        reasons(lambda c: c["rule_id"].startswith("opp.") & (c["points"] > 0)).alias("opportunities"),
        F.concat(reasons(lambda c: c["rule_id"].startswith("qual.") & (c["points"] > 0)), reasons(lambda c: c["points"] < 0)).alias("strengths"),
        F.transform(F.filter(components, lambda c: c["points"] == 0), lambda c: F.concat_ws(": ", c["rule_id"], c["reason"])).alias("unmeasurable"),
    )


def visibility(mentions: Column, checked: Column) -> Column:
    """``m/n``, a dash where nothing was measured."""
    return F.when(checked.isNull() | mentions.isNull(), F.lit("—")).otherwise(F.concat_ws("/", mentions.cast("long").cast("string"), checked.cast("long").cast("string")))


#: What a statement about AI visibility must be able to name.
BASIS = ("ai_query_text", "ai_checked_at", "ai_model_used")


def brief(scored: DataFrame) -> DataFrame:
    """(id, brief, refused): a Markdown page for each company, or why there is none.

    Refused are companies without a score, those with an open blocking flag, and those whose AI visibility
    was checked but cannot name its queries, date and model: a comparison without its basis is not exported.
    """
    missing = [c for c in (*BASIS, "ai_queries_checked", "ai_brand_mentions", "ai_competitors_mentioned", "contact_blocked") if c not in scored.columns]
    rows = scored.select("*", *[F.lit(None).cast("boolean" if c == "contact_blocked" else "double" if c.endswith(("checked", "mentions")) else "string").alias(c) for c in missing])
    unfounded = F.col("ai_queries_checked").isNotNull() & ~F.forall(F.array(*[F.col(c).cast("string") for c in BASIS]), lambda c: F.coalesce(c, F.lit("")) != "")
    refused = F.when(F.col("total").isNull(), "not_scored").when(F.coalesce("contact_blocked", F.lit(False)), "contact_blocked").when(unfounded, "missing_basis")
    found = findings(F.col("components"))

    def listed(title: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"## {title}\n"), F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n")))

    asked = F.array_join(F.transform(F.split("ai_query_text", r"\s*\|\s*"), lambda q: F.concat(F.lit('"'), q, F.lit('"'))), ", ")
    unnamed = (F.col("ai_queries_checked") - F.coalesce("ai_brand_mentions", F.lit(0.0))).cast("long")
    others = F.when((unnamed > 0) & (F.coalesce("ai_competitors_mentioned", F.lit("")) != ""), F.concat(F.lit(" Named instead: "), "ai_competitors_mentioned", F.lit(".")))
    visible = F.when(
        F.col("ai_queries_checked").isNotNull(),
        F.concat(
            F.lit("## AI visibility\nChecked on "), "ai_checked_at", F.lit(" with "), "ai_model_used", F.lit(": "), asked, F.lit(". The brand was not named in "), unnamed.cast("string"), F.lit(" of "),
            F.col("ai_queries_checked").cast("long").cast("string"), F.lit(" answers."), F.coalesce(others, F.lit("")), F.lit(" One model, one day: no statement about such systems in general."),
        ),
    )
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), "domain"), F.format_string("%d points, band %s", "total", "band"), listed("Opportunities", found["opportunities"]), listed("Strengths", found["strengths"]), listed("Not measurable", found["unmeasurable"]), visible)
    return rows.select("id", F.when(refused.isNull(), text).alias("brief"), refused.alias("refused"))
