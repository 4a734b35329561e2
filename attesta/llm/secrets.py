"""Secret scan with corpus-wide ownership frequency, in built-in column functions only.

Base spans follow fixed formats; a generator adds other token-like strings. The value of every
candidate is hashed and the hashes are aggregated over the corpus by distinct repositories and owners
(map-side distinct first, so that a value in a third of all rows costs a few rows a task). A value is a
widely copied example if ``COPIED_OWNERS`` owners or ``COPIED_REPOSITORIES`` repositories hold it; a
value of one owner in fewer repositories is owner-specific and looks live; values in between are shared.
Generated candidates that are not widely copied are added to the base spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import let, sized, staged, table
from attesta.llm.spans import joined, of_kind, sha256, spans

KINDS = ("assign", "access", "hex", "owned")
COPIED_OWNERS = 3
#: Repositories, whoever owns them: an example pasted into so many is one, even if one owner holds them all.
COPIED_REPOSITORIES = 4

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
# Generator: long tokens; those that mix digits with both cases are kept. Dots part tokens.
LOOSE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

VALUE_AT_LEAST = 8
DISTINCT_AT_LEAST = 12


def _ranked(found: Column, rank: int, value) -> Column:
    return F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"),
            F.substring(F.sha2(value(s["match"]).cast("binary"), 256), 1, 32).alias("hash"),
        ),
    )


def base_spans(text: Column) -> Column:
    """Base candidates by start, then kind as listed; ``text`` is never null."""
    def value(m: Column) -> Column:
        return F.regexp_extract(m, ASSIGN, 1)

    # No hint of lower case is lost: the keywords hold ASCII letters only.
    may_assign = F.lower(text).rlike("pass|secret|token|api")
    assigns = F.filter(spans("assign", text, ASSIGN, may_assign), lambda s: F.length(value(s["match"])) >= VALUE_AT_LEAST)
    return F.array_sort(
        F.concat(
            _ranked(assigns, 0, value),
            _ranked(spans("access", text, ACCESS, F.contains(text, F.lit("AKIA"))), 1, lambda m: m),
            _ranked(spans("hex", text, HEX), 2, lambda m: m),
        )
    )


def open_spans(text: Column, base: Column) -> Column:
    """Generated candidates that touch no base span."""
    def varied(m: Column) -> Column:
        return m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]") & (F.size(F.array_distinct(F.split(m, ""))) >= DISTINCT_AT_LEAST)

    found = F.filter(spans("owned", text, LOOSE), lambda s: varied(s["match"]))
    return F.filter(_ranked(found, 3, lambda m: m), lambda s: ~F.exists(base, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))


def scan(documents: DataFrame, owner: Column, repository: Column, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """Return doc_id, ``base`` and ``added`` (arrays of start, rank, end, kind, hash), n_live, n_copied for every row.

    Needs doc_id and text and whatever ``owner`` and ``repository`` read; a repository is known by its
    owner and its name together. ``n_copied``: candidates whose value ``copied_owners`` owners or
    ``copied_repositories`` repositories hold; ``n_live``: those of a single owner in fewer; values
    shared by fewer owners are in neither. Null text is empty; a null owner or repository is one of its
    own, other than the empty string; repeated rows count each by itself and once for ownership; an empty
    table gives an empty result. Texts are searched whole, offsets are code points.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = let(text, lambda t: let(base_spans(t), lambda b: F.struct(b.alias("base"), open_spans(t, b).alias("open"))))
    rows = staged(
        documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", owner.alias("owner"), repository.alias("repository"), found.alias("f")).select(
            "row", "doc_id", "owner", "repository", "f.base", "f.open"
        ),
        "secrets",
    )
    each = rows.where(F.size("base") + F.size("open") > 0).select("row", "owner", "repository", F.explode(F.concat("base", "open")).alias("c"))
    known = (
        each.select(F.col("c.hash").alias("hash"), "owner", "repository")
        .distinct()
        .groupBy("hash", "owner")
        .agg(F.count("*").alias("repositories"))
        .groupBy("hash")
        .agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    )
    copied = (F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories)
    # Most values have one holder, which needs no row here; what is left joins without a shuffle if it is small.
    verdict = staged(known.select("hash", F.when(copied, "copied").when(F.col("owners") > 1, "shared").alias("verdict")).where("verdict is not null"), "verdicts")
    verdicts = (
        each.select("row", "c", F.col("c.hash").alias("hash"))
        .join(sized(verdict, verdict.count()), "hash", "left")
        .groupBy("row")
        .agg(
            F.count_if(F.col("verdict").isNull()).alias("n_live"),
            F.count_if(F.col("verdict") == "copied").alias("n_copied"),
            F.collect_list(F.when((F.col("c.kind") == "owned") & F.coalesce(F.col("verdict") != "copied", F.lit(True)), F.col("c"))).alias("added"),
        )
    )
    return rows.join(verdicts, "row", "left").select(
        "doc_id", "base", F.coalesce("added", F.array().cast(rows.schema["open"].dataType)).alias("added"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    """Owners are the documents' sources; the languages of a source stand for its repositories."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    counts = [F.size(of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return scan(documents, F.col("source"), F.col("lang")).select(
        "doc_id", *counts, sha256(joined(F.col("base"))).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"), "n_live", "n_copied"
    )
