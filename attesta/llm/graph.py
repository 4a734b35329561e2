"""Approximate nearest neighbours on robust-pruned directed graphs, one graph a shard.

Largest inner product becomes least distance by one more component that gives all of a shard's vectors
the same norm. Points enter a shard's graph in batches: a greedy beam search proposes neighbours,
relaxed distance pruning keeps the diverse ones (a candidate goes if a kept neighbour is nearer to it,
by the factor ``ALPHA``, than the point is), and reverse edges are pruned alike. Queries walk every
shard's graph with a beam; the found candidates are scored exactly in double precision.

Equal vectors are one node that carries all their ids. The index is written to the shared folder: a
lost executor costs a re-read, not a rebuild.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import vectors
from attesta.llm.common import staged, table

DEGREE = 32
BUILD_BEAM = 64
BEAM = 96
ALPHA = 1.2
BATCH = 512
ENTRIES = 8
EXPAND = 4
#: Single precision is off by less than this on vectors of norm 1 at most.
ROUNDING = 1e-4
#: Points pruned together; bounds the table of their candidates' distances.
PRUNED = 512


def lifted(x: np.ndarray) -> np.ndarray:
    """``x`` in float32 with a component that makes all norms equal (and about 1)."""
    x = x / (np.abs(x).max(initial=0) or 1)
    norms = (x * x).sum(axis=1)
    most = norms.max()
    return (np.column_stack([x, np.sqrt(np.maximum(most - norms, 0))]) / np.sqrt(most or 1)).astype(np.float32)


def beam_search(points, graph, entries, asked, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(node numbers, their inner products with ``asked``), both (queries, beam), the largest first; -1 where fewer were met."""
    n_queries = len(asked)
    nodes = np.full((n_queries, beam), -1, np.int32)
    value = np.full((n_queries, beam), -np.inf, np.float32)
    done = np.ones((n_queries, beam), bool)
    seen = np.zeros((n_queries, len(points) + 1), bool)  # the last column stands for "no node"
    seen[:, -1] = True
    seen[:, entries] = True
    e = min(len(entries), beam)
    nodes[:, :e], value[:, :e], done[:, :e] = entries[:e], asked @ points[entries[:e]].T, False
    order = np.argsort(-value, axis=1, kind="stable")
    nodes, value, done = (np.take_along_axis(x, order, 1) for x in (nodes, value, done))
    rows = np.arange(n_queries)
    while len(rows):
        rank = np.cumsum(~done[rows], axis=1)
        turn = ~done[rows] & (rank <= EXPAND)
        rows = rows[some] if not (some := turn.any(axis=1)).all() else rows
        turn = turn[some]
        if not len(rows):
            break
        current = np.full((len(rows), EXPAND), -1, np.int32)
        r, c = np.nonzero(turn)
        current[r, rank[some][r, c] - 1] = nodes[rows][r, c]
        done[rows] |= turn
        near = np.where(current[:, :, None] >= 0, graph[current], -1).reshape(len(rows), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[rows[:, None], near]] = -1
        seen[rows[:, None], near] = True
        close = np.full(near.shape, -np.inf, np.float32)
        r, c = np.nonzero(near >= 0)
        close[r, c] = np.einsum("ed,ed->e", points[near[r, c]], asked[rows[r]])
        both = np.concatenate([value[rows], close], axis=1)
        pick = np.argpartition(-both, beam - 1, axis=1)[:, :beam]
        pick = np.take_along_axis(pick, np.argsort(-np.take_along_axis(both, pick, 1), axis=1, kind="stable"), 1)
        value[rows] = np.take_along_axis(both, pick, 1)
        nodes[rows] = np.take_along_axis(np.concatenate([nodes[rows], near], axis=1), pick, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], near < 0], axis=1), pick, 1)
    return nodes, value


def robust_prune(points, of, candidates, degree: int) -> np.ndarray:
    """For each point ``of`` its kept neighbours (rows, degree) out of ``candidates`` (-1: none)."""
    parts = range(0, len(of), PRUNED)
    return np.concatenate([_pruned(points, of[i : i + PRUNED], candidates[i : i + PRUNED], degree) for i in parts])


def _pruned(points, of, candidates, degree: int) -> np.ndarray:
    own = points[of]
    # Norms are equal: the squared distance is twice (norm - inner product).
    far = 2 * (1 - np.einsum("qrd,qd->qr", points[candidates], own))
    far[(candidates < 0) | (candidates == np.asarray(of)[:, None])] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    vecs = points[candidates]
    apart = 2 * (1 - vecs @ vecs.transpose(0, 2, 1))
    kept = np.full((len(own), degree), -1, np.int32)
    rows = np.arange(len(own))
    for i in range(degree):
        first = np.argmin(far, axis=1)
        alive = np.isfinite(far[rows, first])
        if not alive.any():
            break
        kept[alive, i] = candidates[rows, first][alive]
        far[ALPHA * apart[rows, first] <= far] = np.inf
        far[rows, first] = np.inf
    return kept


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(graph: node -> neighbours with -1 for none, entry nodes)."""
    n = len(points)
    graph = np.full((n, DEGREE), -1, np.int32)
    order = np.random.default_rng(n).permutation(n)
    first = min(n, BATCH // 4)
    core = order[:first]
    graph[core] = robust_prune(points, core, np.repeat(core[None, :], first, 0).astype(np.int32), DEGREE)
    centre = core[int(np.argmax(points[core] @ points.mean(axis=0)))]
    entries = np.unique(np.concatenate([[centre], core[:ENTRIES]]))
    at = first
    while at < n:
        batch = order[at : at + min(BATCH, at)]
        at += len(batch)
        found, _ = beam_search(points, graph, entries, points[batch], BUILD_BEAM)
        graph[batch] = robust_prune(points, batch, found, DEGREE)
        _reverse(points, graph, batch)
    return graph, entries


def _reverse(points, graph, batch) -> None:
    """Add the edges back to ``batch`` and prune the nodes that then have too many."""
    r, c = np.nonzero(graph[batch] >= 0)
    to, source = graph[batch][r, c], batch[r]
    near = np.einsum("ed,ed->e", points[to], points[source])
    order = np.lexsort((-near, to))
    to, source = to[order], source[order]
    nodes, start, count = np.unique(to, return_index=True, return_counts=True)
    nth = np.arange(len(to)) - np.repeat(start, count)
    extra = np.full((len(nodes), DEGREE), -1, np.int32)
    few = nth < DEGREE
    extra[np.repeat(np.arange(len(nodes)), count)[few], nth[few]] = source[few]
    both = np.sort(np.concatenate([graph[nodes], extra], axis=1), axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    fits = (both >= 0).sum(axis=1) <= DEGREE
    graph[nodes[fits]] = -np.sort(-both[fits], axis=1)[:, :DEGREE]
    if not fits.all():
        graph[nodes[~fits]] = robust_prune(points, nodes[~fits], both[~fits], DEGREE)


INDEX = "shard int, ids binary, node binary, vectors binary, width int, graph binary, entries binary"


def index(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(one row per shard with its vectors and graph, number of shards); every row that takes part is in it."""
    rows = vectors.usable(embeddings, nonzero=True)
    n, _ = vectors.counts(rows)

    def run(key, group):
        ids, x = vectors.matrix(group)
        distinct, node = np.unique(x, axis=0, return_inverse=True)
        graph, entries = build(lifted(distinct))
        parts = (ids.astype("<i8"), node.reshape(-1).astype("<i4"), distinct.astype("<f8"))
        ids, node, data = (p.tobytes() for p in parts)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "ids": [ids], "node": [node], "vectors": [data], "width": pa.array([x.shape[1]], pa.int32()), "graph": [graph.tobytes()], "entries": [entries.astype("<i4").tobytes()]})

    return vectors.sharded(rows, n).groupBy("shard").applyInArrow(run, INDEX), max(1, -(-n // vectors.SHARD))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed in component order, so that equal vectors score equally."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += x[:, i] * q[:, i]
    return total


def search(row: dict, query_ids: np.ndarray, asked: np.ndarray, k: int, beam: int):
    """(query positions, vec_ids, scores) of the ``k`` nearest found in one shard, own ids left out."""
    ids, node = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["node"], "<i4")
    x = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["width"])
    graph, entries = np.frombuffer(row["graph"], "<i4").reshape(len(x), -1), np.frombuffer(row["entries"], "<i4")
    x, asked = vectors.same_width(x, asked)
    points = lifted(x)
    wanted = asked / np.maximum(np.abs(asked).max(axis=1, initial=0), 1e-300)[:, None]
    wanted = np.column_stack([wanted / np.maximum(np.sqrt((wanted * wanted).sum(axis=1)), 1e-300)[:, None], np.zeros(len(asked))]).astype(np.float32)
    met = [beam_search(points, graph, entries, wanted[i : i + BATCH], beam) for i in range(0, len(wanted), BATCH)]
    found, value = (np.concatenate(m) for m in zip(*met, strict=True))
    # Only what could be among the k best once scored exactly; the query itself may be among the first k + 1.
    q, c = np.nonzero((found >= 0) & (value >= value[:, [min(k, beam - 1)]] - ROUNDING))
    at = found[q, c]
    score = products(x[at], asked[q])
    # Of a node's rows the k first of each id count, and of those the first 2 k: enough for the best k without the query's own.
    by_node = np.lexsort((ids, node))
    key = np.stack([node[by_node], ids[by_node]])
    run = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
    by_node = by_node[np.arange(len(ids)) - np.repeat(run, np.diff(np.append(run, len(ids)))) < k]
    starts, sizes = np.searchsorted(node[by_node], np.arange(len(x))), np.minimum(np.bincount(node[by_node], minlength=len(x)), 2 * k)
    times = sizes[at]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    q, score, vec = np.repeat(q, times), np.repeat(score, times), ids[by_node[np.repeat(starts[at], times) + nth]]
    other = vec != query_ids[q]
    q, score, vec = q[other], score[other], vec[other]
    order = np.lexsort((vec, -score, q))
    q, score, vec = q[order], score[order], vec[order]
    start = np.searchsorted(q, np.arange(len(asked)))
    best = np.arange(len(q)) - start[q] < k
    return q[best], vec[best], score[best]


def nearest(embeddings: DataFrame, k: int = vectors.TOP, beam: int = BEAM) -> DataFrame:
    """Return query_id, rank, vec_id, score: the ``k`` nearest found of each query row by inner product.

    Needs vec_id and embedding. Rows with a null id, a null, zero or empty vector or a null or non-finite
    component take no part. A row is no candidate for a query of its own id; other rows that repeat an id
    are candidates each, and query rows that repeat one are one query, which gets the best of their answers.
    Shorter vectors count as filled with zeros; ties go to the smaller vec_id. Shards no larger than the beam are searched whole. With no
    queries or a single row the result is empty. Other columns are ignored.
    """
    rows = vectors.usable(embeddings, nonzero=True)
    made, shards = index(embeddings)
    made = staged(made, "graph")
    _, n_queries = vectors.counts(rows)
    asked, groups = vectors.queries(rows, n_queries, shards)
    made = made.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        query_ids, q = vectors.matrix(right)
        at, found, score = search(left.to_pylist()[0], query_ids, q, k, beam)
        return pa.Table.from_arrays([pa.array(query_ids[at]), pa.array(found), pa.array(score)], schema=schema)

    pairs = made.groupBy("shard", "grp").cogroup(asked.groupBy("shard", "grp")).applyInArrow(run, "query_id long, vec_id long, score double")
    return vectors.ranked(pairs, k)


def op4_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
