"""Text functions: normalisation, verification, caps, brand terms, answers in prose."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

BYTE_CAP = 61_440
CAP_MARK = "\n[cut]"
BRANDS_AT_MOST, BRAND_CHARS = 8, 80


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use inside ``body``; within lambdas a column used twice is evaluated twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalised(text: Column) -> Column:
    """White space collapsed, case folded (``ß`` counts as ``ss``)."""
    return F.replace(F.lower(collapsed(text)), F.lit("ß"), F.lit("ss"))


def verified(value: Column, page: Column) -> Column:
    """Whether the page holds the value, both normalised; null where either is null. An empty value is an error."""
    wanted = normalised(value)
    return F.when(wanted == "", F.raise_error(F.lit("an empty value cannot be verified")).cast("boolean")).otherwise(F.contains(normalised(page), wanted))


def verified_boolean(value: Column, evidence: Column, page: Column) -> Column:
    """A claimed boolean through its evidence: null without one, else whether the page holds the span."""
    return F.when(value.isNull() | evidence.isNull() | (F.trim(evidence) == ""), None).otherwise(verified(evidence, page))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@pandas_udf(StringType())
def _cut(text: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else t.encode()[:n].decode(errors="ignore") for t, n in zip(text, most, strict=True)], dtype="object")


def capped(text: Column, most: int = BYTE_CAP, mark: str = CAP_MARK) -> Column:
    """At most ``most`` UTF-8 bytes with ``mark`` at the end where something was cut, never within a character."""
    room = most - len(mark.encode())
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(_cut(text, F.lit(room)), F.lit(mark)))


def spaced(text: Column) -> Column:
    """Lower case with everything but letters and digits a space, one space at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def brand_terms(domain: Column, legal_name: Column, legal_form: str = r"(?i)\s*\b(?:gmbh|ug|ag|kg|ohg|gbr|e\.\s?k\.|ltd)\b.*$") -> Column:
    """Domain, its first label and the legal name without its form; the latter two from four characters on."""
    label = F.element_at(F.split(domain, r"\."), 1)
    name = F.trim(F.regexp_replace(legal_name, legal_form, ""))
    terms = F.array(F.lower(domain), F.when(F.length(label) >= 4, F.lower(label)), F.when(F.length(name) >= 4, F.lower(name)))
    return F.array_distinct(F.array_compact(terms))


def mentioned(answer: Column, terms: Column) -> Column:
    """A term stands in the answer as whole words, or written together."""
    words = spaced(answer)
    joined = F.regexp_replace(words, " ", "")
    return F.exists(terms, lambda t: F.contains(words, spaced(t)) | F.contains(joined, F.regexp_replace(spaced(t), " ", "")))


def category_term(categories: Column) -> Column:
    """The first of a ``|``-separated list that has three characters or more."""
    return F.get(F.filter(F.transform(F.split(categories, r"\|"), lambda c: F.trim(c)), lambda c: F.length(c) >= 3), 0)


def queries(category: Column, city: Column, shop: Column) -> Column:
    """Two questions about a category, and a third where the city is known."""
    return F.array_compact(
        F.array(
            F.concat(F.lit("Welche Online-Shops für "), category, F.lit(" sind zu empfehlen?")),
            F.concat(F.lit("Wo kauft man "), category, F.lit(" am besten online?")),
            F.concat(F.lit("Anbieter für "), category, F.lit(" in "), city),
        )
    )


def brands(names: Column) -> Column:
    """Collapsed, each new one cut to ``BRAND_CHARS``, ``BRANDS_AT_MOST`` of them.

    A name is new if no kept one, as cut, has its whole lower-case spelling: the cut comes after the comparison.
    """
    clean = F.filter(F.transform(names, collapsed), lambda n: n != "")

    def add(kept: Column, name: Column) -> Column:
        return F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(name)), kept).otherwise(F.concat(kept, F.array(F.substring(name, 1, BRAND_CHARS))))

    return F.slice(F.aggregate(clean, F.array().cast("array<string>"), add), 1, BRANDS_AT_MOST)


@pandas_udf(StringType())
def json_object(answer: pd.Series) -> pd.Series:
    """The JSON object within prose: from the first to the last brace, else the first balanced one; else null."""
    import json

    def one(text):
        if not text or "{" not in text:
            return None
        start = text.index("{")
        depth = 0
        ends = [i + 1 for i in range(start, len(text)) if (depth := depth + (text[i] == "{") - (text[i] == "}")) == 0 and text[i] == "}"][:1]
        for end in (text.rfind("}") + 1, *ends):
            try:
                found = json.loads(text[start:end])
            except ValueError:
                continue
            if isinstance(found, dict):
                return json.dumps(found, ensure_ascii=False)
        return None

    return answer.map(one)


def custom_id(kind: Column, company: Column, artifact: Column) -> Column:
    return F.concat_ws("-", kind, company.cast("string"), artifact.cast("string"))


def parsed_custom_id(value: Column) -> Column:
    """kind, company_id, artifact_id of a well-formed id; null otherwise."""
    shape = r"^([a-z_]+)-([0-9]+)-([0-9]+)$"
    return F.when(
        value.rlike(shape),
        F.struct(F.regexp_extract(value, shape, 1).alias("kind"), F.regexp_extract(value, shape, 2).try_cast("bigint").alias("company_id"), F.regexp_extract(value, shape, 3).try_cast("bigint").alias("artifact_id")),
    )


def rendered(num: Column, text: Column, day: Column) -> Column:
    """A value as a diff shows it: numbers without ``.0``, dates, texts in brackets behind a number, ∅ for none."""
    number = F.when(num == F.floor(num), F.floor(num).cast("string")).otherwise(num.cast("string"))
    bracket = F.when(text.isNotNull(), F.concat(F.lit("("), text, F.lit(")")))
    return F.when(num.isNotNull(), F.concat_ws(" ", number, bracket)).when(day.isNotNull(), day.cast("string")).otherwise(F.coalesce(text, F.lit("∅")))


def evidence(text: Column, day: Column, num: Column) -> Column:
    """Text, else date, else number; an empty text falls through."""
    return F.coalesce(F.nullif(text, F.lit("")), day.cast("string"), num.cast("string"))
