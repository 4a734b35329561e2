"""Vectors dealt into bounded shards and query groups, for searches of a stated query set against all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_EVERY = 20
TOP = 20
#: Vectors a shard and queries a group hold at most, about; both bound a task whatever the table's size.
SHARD = 4096
GROUP = 2048


def usable(embeddings: DataFrame, nonzero: bool = False) -> DataFrame:
    """vec_id, embedding of the rows that take part: no null id, vector or component, all components finite."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return rows.where(F.exists("embedding", lambda x: x != 0)) if nonzero else rows


def sharded(rows: DataFrame, count: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(max(1, -(-count // SHARD)))).cast("int"))


def counts(rows: DataFrame) -> tuple[int, int]:
    """(vectors, queries)."""
    r = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % QUERY_EVERY == 0).alias("q")).first()
    return r["n"], r["q"]


def queries(rows: DataFrame, n_queries: int, n_shards: int) -> tuple[DataFrame, int]:
    """(the query rows, dealt into groups and sent to every shard, number of groups): each (shard, grp) is one bounded task."""
    groups = max(1, -(-n_queries // GROUP))
    return (
        rows.where(F.col("vec_id") % QUERY_EVERY == 0)
        .withColumn("grp", F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(groups)).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    ), groups


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors as float64) in order of id, then vector; repeated ids all stay. Shorter vectors are filled with zeros."""
    ids = table.column("vec_id").to_numpy()
    lists = table.column("embedding").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.asarray(lists.value_lengths()).astype(np.int64)
    width = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(ids), width))
    out[np.arange(width) < lengths[:, None]] = values
    order = np.lexsort((*out.T[::-1], ids))
    return ids[order], out[order]


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def ranked(found: DataFrame, k: int = TOP) -> DataFrame:
    """The best ``k`` of each query over all shards, ties to the smaller vec_id."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
