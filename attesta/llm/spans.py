"""Match positions as built-in column expressions: a text's leftmost non-overlapping matches with code-point offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.llm.common import let

SPAN = "array<struct<kind:string,start:int,end:int,match:string>>"


def _located(kind: str, gaps: Column, found: Column) -> Column:
    """``gaps``: the texts around the matches, ``found``: the matches. Offsets are prefix sums, taken
    over blocks of about sqrt(n) so that many matches in one text stay cheap."""
    both = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))

    def offsets(b: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(b))).cast("int"))

        def add(a, x):
            return a + x

        def blocks(w: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.size(b) - 1) / w).cast("int")), lambda j: F.aggregate(F.slice(b, j * w + 1, w), F.lit(0), add))
            starts = let(sums, lambda s: F.transform(s, lambda x, j: F.aggregate(F.slice(s, F.lit(1), j), F.lit(0), add)))
            return let(
                starts,
                lambda s: F.transform(
                    found,
                    lambda m, i: F.struct(
                        F.lit(kind).alias("kind"),
                        (F.get(s, F.floor(i / w).cast("int")) + F.aggregate(F.slice(b, F.floor(i / w).cast("int") * w + 1, i % w), F.lit(0), add) + F.length(F.get(gaps, i))).cast("int").alias("start"),
                        m.alias("match"),
                    ),
                ),
            )

        return let(width, blocks)

    placed = let(both, offsets)
    return F.transform(
        placed,
        lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["match"])).cast("int").alias("end"), x["match"].alias("match")),
    )


def spans(kind: str, text: Column, pattern: str, guard: Column | None = None) -> Column:
    """All matches of ``pattern`` in ``text`` (never null) as ``SPAN``; where ``guard`` is false the pattern isn't tried."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(SPAN)
    located = let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda g: _located(kind, g, m))))
    return located if guard is None else F.when(guard, located).otherwise(none)


def joined(all_spans: Column) -> Column:
    """``kind:start:end`` comma-joined, in the order given."""
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def of_kind(all_spans: Column, kind: str) -> Column:
    return F.filter(all_spans, lambda s: s["kind"] == kind)
