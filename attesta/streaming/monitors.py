"""Request spacing and spend as streams: state is kept per key, late rows beyond the watermark are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def spend_by_window(ledger: DataFrame, late: str = "1 day", length: str = "30 days", slide: str = "1 day") -> DataFrame:
    """(at, amount) -> spend of each sliding window, final once the watermark has passed it."""
    window = F.window("at", length, slide)
    return ledger.withWatermark("at", late).groupBy(window.alias("w")).agg(F.sum("amount").alias("spent")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "spent")


def requests_by_window(log: DataFrame, late: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """(host, at) -> requests of each host and tumbling window."""
    return log.withWatermark("at", late).groupBy(F.window("at", length).alias("w"), "host").agg(F.count("*").alias("requests")).select(F.col("w.start").alias("start"), "host", "requests")


def spacing(log: DataFrame) -> DataFrame:
    """(host, issued) -> running count and least gap of each host, updated per trigger.

    State is the last issue time, the count and the least gap: three numbers a host. Rows that arrive
    out of order within a trigger are sorted; one that is older than the state is compared with it as is.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count, least = state.get if state.exists else (None, 0, None)
        times = sorted(t for b in batches for t in b["issued"])
        for t in times:
            if last is not None:
                gap = abs(t - last)
                least = gap if least is None or gap < least else least
            last, count = t if last is None else max(t, last), count + 1
        state.update((last, count, least))
        yield pd.DataFrame({"host": [key[0]], "requests": [count], "min_gap": [least]})

    return log.groupBy("host").applyInPandasWithState(update, "host long, requests long, min_gap double", "last double, n long, least double", "update", GroupStateTimeout.NoTimeout)
