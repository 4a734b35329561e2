"""Dates in text and on the page, with validity instead of guesses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import let

# Month names, in full and short.
MONTHS = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
ALIASES = {"maerz": 3, "mär": 3, "jan": 1, "feb": 2, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "okt": 10, "nov": 11, "dez": 12}

ISO = r"(?<![0-9])([0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])"
NAMED = r"(?iu)(?<![\p{L}0-9_])([0-9]{1,2})\.\s*([a-zäöü]+)\.?\s+([0-9]{4})(?![\p{L}0-9_])"
NUMERIC = r"(?<![\p{L}0-9_])([0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\p{L}0-9_])"


def iso_date(text: Column) -> Column:
    """The first ISO date anywhere, also one that opens a timestamp; null if there is none or it is no day."""
    return F.try_to_date(F.nullif(F.regexp_extract(text, ISO, 1), F.lit("")), "yyyy-MM-dd")


def month_number(name: Column) -> Column:
    words = [*((m.lower(), i) for i, m in enumerate(MONTHS, 1)), *ALIASES.items()]
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in words for v in pair]), F.lower(name))


def german_date(text: Column) -> Column:
    """A written-out date, else a numeric one, else an ISO one, in that order of kinds; a day that does not
    exist ends the search."""
    def part(i: int) -> Column:
        return F.regexp_extract(text, NAMED, i)

    def named(p: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", p["year"], F.lpad(p["month"].cast("string"), 2, "0"), F.lpad(p["day"], 2, "0")), "yyyy-MM-dd")

    def numeric(found: Column) -> Column:
        return F.when(found != "", F.try_to_date(found, "d.M.yyyy")).otherwise(iso_date(text))

    parts = F.struct(part(1).alias("day"), month_number(part(2)).alias("month"), part(3).alias("year"))
    # Without a digit before a full stop there is neither a written-out nor a numeric date.
    dotted = let(parts, lambda p: F.when(p["month"].isNotNull(), named(p)).otherwise(let(F.regexp_extract(text, NUMERIC, 1), numeric)))
    return F.when(text.rlike(r"[0-9]\."), dotted).otherwise(iso_date(text))


def month_year(day: Column) -> Column:
    return F.concat_ws(" ", F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day)), F.year(day).cast("string"))


def months_since(day: Column, today: Column) -> Column:
    """Calendar months, never below zero."""
    return F.greatest(F.lit(0), (F.year(today) - F.year(day)) * 12 + F.month(today) - F.month(day))


def display(day: Column) -> Column:
    return F.date_format(day, "dd.MM.yyyy")


def instant(text: Column) -> Column:
    """An ISO instant with ``Z`` or an offset; null if unreadable."""
    return F.try_to_timestamp(F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+(?:Z|[+-][0-9]{2}:?[0-9]{2})?$"), text))
