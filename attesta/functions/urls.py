"""URL and host functions as built-in column expressions; IDNA and relative resolution as Arrow functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Top-level domains that name a country, and one that names a country out of scope.
TLD_COUNTRY = {"de": "DE", "at": "AT", "ch": "CH", "lu": "LU"}
OUT_OF_SCOPE_TLD = {"li": "LI"}
# Schemes that are no pages.
NOT_PAGES = r"(?i)^(?:#|mailto:|tel:|javascript:)"


@pandas_udf(StringType())
def idna(host: pd.Series) -> pd.Series:
    """Punycode of non-ASCII hosts; what cannot be encoded stays lower case."""
    def one(h):
        if h is None:
            return None
        try:
            return h.encode("idna").decode("ascii")
        except UnicodeError:
            return h.lower()

    return host.map(one)


@pandas_udf(StringType())
def resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    """``href`` against ``base`` without its fragment; null unless the result is http(s)."""
    from urllib.parse import urldefrag, urljoin, urlsplit

    def one(b, h):
        if b is None or h is None:
            return None
        try:
            url = urldefrag(urljoin(b, h.strip())).url
            parts = urlsplit(url)
        except ValueError:
            return None
        if parts.scheme not in ("http", "https") or not parts.netloc:
            return None
        return url if parts.path else parts._replace(path="/").geturl()

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype="object")


def absolute(base: Column, href: Column) -> Column:
    """``resolved``, with addresses that are no pages (and empty ones) null."""
    return F.when(href.rlike(NOT_PAGES) | (F.trim(href) == ""), None).otherwise(resolved(base, href))


def _netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def authority(url: Column) -> Column:
    """Host and port, without user information, lower case; null without a host."""
    return F.nullif(F.lower(F.regexp_replace(_netloc(url), r"^.*@", "")), F.lit(""))


def hostname(url: Column) -> Column:
    return F.regexp_replace(authority(url), r":[0-9]*$", "")


def host(url: Column) -> Column:
    """The hostname without one leading ``www.``."""
    return F.regexp_replace(hostname(url), r"^www\.", "")


def origin(url: Column) -> Column:
    return F.concat(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("://"), authority(url))


def path(url: Column) -> Column:
    """The path, ``/`` if empty."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), F.lit("")), F.lit("/"))


def has_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1) != ""


def same_site(url: Column, domain: Column) -> Column:
    """The host is the domain or one below it."""
    found = host(url)
    return F.coalesce((found == domain) | found.endswith(F.concat(F.lit("."), domain)), F.lit(False))


def normalised_domain(value: Column) -> Column:
    """The host of a domain or URL as typed, one ``www.`` dropped; null unless it has a dot."""
    text = F.lower(F.trim(value))
    bare = F.regexp_replace(F.regexp_replace(text, r"^[a-z][a-z0-9+.-]*://", ""), r"[/?#].*$", "")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    bare = F.regexp_replace(bare, r"^www\.", "")
    bare = F.when(bare.rlike(r"[^\x00-\x7F]"), idna(bare)).otherwise(bare)
    return F.when(bare.rlike(r"^[^\s.]+(?:\.[^\s.]+)+$"), bare)


def slash_depth(path_: Column) -> Column:
    """Slashes of a path without its trailing ones."""
    return F.length(F.regexp_replace(F.regexp_replace(path_, "/+$", ""), "[^/]", ""))


def segment_depth(path_: Column) -> Column:
    """Non-empty segments of a path."""
    return F.size(F.filter(F.split(path_, "/"), lambda s: s != ""))


def country(domain: Column, tagged: Column | None = None) -> Column:
    """The country the top-level domain names, else the run's tag; a domain out of scope stops at null."""
    tld = F.element_at(F.split(F.regexp_replace(F.lower(F.trim(domain)), r"\.+$", ""), r"\."), -1)
    named = F.lit(None).cast("string")
    for suffix, code in TLD_COUNTRY.items():
        named = F.when(tld == suffix, F.lit(code)).otherwise(named)
    fallback = F.lit(None).cast("string") if tagged is None else F.when(tagged.isin(*TLD_COUNTRY.values()), tagged)
    return F.when(tld.isin(*OUT_OF_SCOPE_TLD), None).otherwise(F.coalesce(named, fallback))
