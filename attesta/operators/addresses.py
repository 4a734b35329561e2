"""Which addresses a fetcher must refuse: containment in reserved networks, as a range join on numbers."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from attesta.functions.text import let

# Reserved networks and why they are refused.
NETWORKS = (
    ("0.0.0.0/8", "unspecified"), ("10.0.0.0/8", "private"), ("100.64.0.0/10", "carrier-grade NAT"), ("127.0.0.0/8", "loopback"), ("169.254.0.0/16", "link-local (cloud metadata)"),
    ("172.16.0.0/12", "private"), ("192.0.0.0/24", "IETF protocol assignments"), ("192.0.2.0/24", "documentation"), ("192.168.0.0/16", "private"), ("198.18.0.0/15", "benchmarking"),
    ("198.51.100.0/24", "documentation"), ("203.0.113.0/24", "documentation"), ("224.0.0.0/4", "multicast"), ("240.0.0.0/4", "reserved"),
    ("::/128", "unspecified"), ("::1/128", "loopback"), ("100::/64", "discard-only"), ("2001:db8::/32", "documentation"), ("fc00::/7", "unique-local"), ("fe80::/10", "link-local"), ("ff00::/8", "multicast"),
)


_NETS = tuple((ipaddress.ip_network(c), why) for c, why in NETWORKS)


def number(address: Column) -> Column:
    """An IPv4 address as a number, null for anything else."""
    shape = address.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$")
    parts = F.transform(F.split(address, r"\."), lambda p: p.try_cast("bigint"))
    joined = let(parts, lambda p: F.when(F.forall(p, lambda x: x <= 255), F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)))
    return F.when(shape, joined)


def ranges() -> list[tuple[int, int, str]]:
    nets = [(ipaddress.ip_network(c), why) for c, why in NETWORKS]
    return [(int(n.network_address), int(n.broadcast_address), why) for n, why in nets if n.version == 4]


def refused_v4(address: Column) -> Column:
    """Why an IPv4 address is refused, null for a public one: a few comparisons, no join needed."""
    def judged(n: Column) -> Column:
        out = F.when(n.isNull(), F.lit(None).cast("string"))
        for low, high, why in ranges():
            out = out.when(n.between(low, high), why)
        return out

    return let(number(address), judged)


@pandas_udf(StringType())
def refused(address: pd.Series) -> pd.Series:
    """As ``refused_v4`` for both families; an IPv4 address in IPv6 notation is judged as itself. Each distinct address is parsed once."""
    def one(text):
        try:
            a = ipaddress.ip_address(text)
        except (TypeError, ValueError):
            return None
        a = getattr(a, "ipv4_mapped", None) or a
        return next((why for net, why in _NETS if a.version == net.version and a in net), None)

    return address.map({text: one(text) for text in address.unique()})


def verdict(resolved: DataFrame) -> DataFrame:
    """(host, address) -> (host, allowed): one refused address refuses the host. Only addresses other than IPv4 pass through Python."""
    v4 = number(F.col("address")).isNotNull()
    plain = resolved.where(v4).select("host", refused_v4(F.col("address")).isNull().alias("fine"))
    other = resolved.where(~v4 | F.col("address").isNull()).select("host", refused(F.col("address")).isNull().alias("fine"))
    return plain.unionByName(other).groupBy("host").agg(F.bool_and("fine").alias("allowed"))
