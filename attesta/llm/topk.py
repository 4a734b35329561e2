"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integer term weights and are laid out once, by ranges of ids, as blocks of ``BLOCK``
vectors (a dense forward index, written to the shared folder). A query sums, over its terms, the most
that a block's largest and smallest weights can add, and lowers that bound where the distance of the
block's vectors from their centre allows; it visits the blocks in order of the bound, scores a block
through its forward index and stops once the next bound is below its k-th score.

Every query first searches one range, dealt by hash; the k-th score found there is where it starts in all
others. Every (range, query group) pair is a bounded task; the best of all are merged per query.
How much is skipped depends on the vectors: where ids that are close hold alike vectors most blocks are,
on vectors without any such order none is, and the search is a full scan (``pruning`` reports the share).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm import vectors
from attesta.llm.common import lean, sized, staged, table

BLOCK = 128
SCALE = 64
LONG = np.iinfo(np.int64)


def weights(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(SCALE * x))


def exact_type(a: np.ndarray, b: np.ndarray):
    """The fastest type in which every inner product of rows of ``a`` and ``b`` is exact."""
    with np.errstate(over="ignore"):
        most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def bounds(docs: np.ndarray, starts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """(queries, blocks): no inner product of a query with a vector of the block is larger."""
    top, low = np.maximum.reduceat(docs, starts), np.minimum.reduceat(docs, starts)
    most = np.maximum(asked, 0) @ top.T + np.minimum(asked, 0) @ low.T
    if docs.dtype == object:
        return most
    sizes = np.diff(np.append(starts, len(docs)))
    centre = np.add.reduceat(docs, starts, dtype=np.float64) / sizes[:, None]
    radius = np.sqrt(np.maximum.reduceat(((docs - np.repeat(centre, sizes, axis=0)) ** 2).sum(axis=1), starts))
    around = asked @ centre.T + np.sqrt((asked.astype(np.float64) ** 2).sum(axis=1))[:, None] * radius
    return np.minimum(most, np.floor(around + 1e-9 * np.abs(around) + 1e-3))


def search(ids: np.ndarray, docs: np.ndarray, query_ids: np.ndarray, asked: np.ndarray, k: int, starts=None, least=None):
    """(query positions, vec_ids, scores) of the ``k`` best of each query, rows of its own id left out, and how many
    blocks each query scored. ``starts``: where the blocks begin; ``least``: scores below which nothing counts."""
    kind = exact_type(docs, asked)
    if kind is object:
        docs, asked = (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (docs, asked))
    else:
        docs, asked = docs.astype(kind), asked.astype(kind)
    starts = np.arange(0, len(ids), BLOCK) if starts is None else starts
    ends = np.append(starts[1:], len(ids))
    bound = bounds(docs, starts, asked)
    order = np.argsort(-bound, axis=1, kind="stable")
    lowest = -(1 << 200) if kind is object else -np.inf
    floor = np.full(len(asked), lowest, object if kind is object else np.float64) if least is None else least
    best = np.full((len(asked), k), lowest, kind)
    best_ids = np.full((len(asked), k), LONG.max)
    active, scored = np.arange(len(asked)), np.zeros(len(asked), np.int64)
    for r in range(len(starts)):
        at = order[active, r]
        going = bound[active, at] >= np.maximum(best[active, -1], floor[active])
        active, at = active[going], at[going]
        if not len(active):
            break
        scored[active] += 1
        by_block = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[by_block])) + 1
        for rows in np.split(by_block, cuts):
            b, rows = at[rows[0]], active[rows]
            there = ids[starts[b] : ends[b]]
            score = asked[rows] @ docs[starts[b] : ends[b]].T
            score[there[None, :] == query_ids[rows][:, None]] = lowest
            better = (score >= np.maximum(best[rows, -1], floor[rows])[:, None]).any(axis=1)
            rows, score = rows[better], score[better]
            if len(rows):
                both = np.concatenate([best[rows], score], axis=1)
                both_ids = np.concatenate([best_ids[rows], np.where(score == lowest, LONG.max, there[None, :])], axis=1)
                pick = np.lexsort((both_ids, -both), axis=1)[:, :k]
                best[rows], best_ids[rows] = np.take_along_axis(both, pick, 1), np.take_along_axis(both_ids, pick, 1)
    q, j = np.nonzero(best_ids != LONG.max)
    return q, best_ids[q, j], best[q, j], scored


INDEX = "part int, block long, ids binary, weights binary, width int, single boolean"


def index(rows: DataFrame, n: int) -> DataFrame:
    """The forward index of usable ``rows``: one row per block of vectors with consecutive ids, in partitions (``part``)
    by ranges of ids. Rows that repeat one id in plenty are parted by their vectors."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("weights", pa.binary()), ("width", pa.int32()), ("single", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, number, held = TaskContext.get().partitionId(), 0, []

        def block(part: pa.Table) -> pa.RecordBatch:
            ids, x = vectors.matrix(part)
            w = weights(x)
            single = bool(np.abs(w).max(initial=0) < 2**24)
            values = [place, number, ids.astype("<i8").tobytes(), w.astype("<f4" if single else "<f8").tobytes(), w.shape[1], single]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            held.append(batch)
            whole = pa.Table.from_batches(held)
            while whole.num_rows >= BLOCK:
                yield block(whole.slice(0, BLOCK))
                whole, number = whole.slice(BLOCK), number + 1
            held = whole.to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    ranges = rows.repartitionByRange(max(1, -(-n // vectors.SHARD)), "vec_id", F.xxhash64("embedding")).sortWithinPartitions("vec_id")
    return lean(ranges).mapInArrow(run, INDEX)


def _loaded(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, weights, block starts) of a range's blocks."""
    rows = sorted(blocks.to_pylist(), key=lambda r: (r["part"], r["block"]))
    ids = [np.frombuffer(r["ids"], "<i8") for r in rows]
    width = max(r["width"] for r in rows)
    parts = [np.frombuffer(r["weights"], "<f4" if r["single"] else "<f8").reshape(len(i), r["width"]).astype(np.float64) for i, r in zip(ids, rows, strict=True)]
    return np.concatenate(ids), np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts]), np.cumsum([0, *map(len, ids)])[:-1]


FOUND = "query_id long, vec_id long, score long, blocks long"


def _searched(blocks: DataFrame, asked: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``FOUND`` rows of every query (vec_id, embedding, least, least_id: the k-th score and id that it knows) in the blocks that share its ``keys``; besides its best
    a query has one row without vec_id, whose score counts the blocks it scored, out of ``blocks``."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("blocks", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids, docs, starts = _loaded(left)
        query_ids, q = vectors.matrix(right)
        known = {i: (s, v) for i, s, v in zip(*(right.column(c).to_pylist() for c in ("vec_id", "least", "least_id")), strict=True)}
        docs, q = vectors.same_width(docs, q)
        least = [known[i] for i in query_ids.tolist()]
        floor = np.array([-(1 << 200) if s is None or s == LONG.min else s for s, _ in least], object)
        at, found, score, scored = search(ids, docs, query_ids, weights(q), k, starts, floor)
        held = [min(max(int(s), int(LONG.min)), int(LONG.max)) for s in score]
        # A score equal to the k-th known counts only under a smaller id.
        some = [s != least[a][0] or v <= least[a][1] for a, v, s in zip(at, found, held, strict=True)]
        at, found, held = at[some], found[some], [s for s, h in zip(held, some, strict=True) if h]
        columns = [np.concatenate([query_ids[at], query_ids]).tolist(), [*found.tolist(), *[None] * len(query_ids)], [*held, *scored.tolist()], [*[None] * len(held), *[len(starts)] * len(query_ids)]]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return blocks.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, FOUND)


def _found(embeddings: DataFrame, k: int) -> DataFrame:
    """``FOUND`` rows over all ranges."""
    rows = vectors.usable(embeddings)
    n, n_queries = vectors.counts(rows)
    blocks, shards = staged(index(rows, n), "blocks"), max(1, -(-n // vectors.SHARD))
    # Neighbouring partitions make a range of about ``vectors.SHARD`` vectors, however many partitions there are.
    parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    blocks = blocks.withColumn("shard", F.floor(F.col("part") * shards / max(parts, shards)).cast("int"))
    queries = rows.where(F.col("vec_id") % vectors.QUERY_EVERY == 0)
    own = F.pmod(F.xxhash64("vec_id", F.lit("first")), F.lit(shards)).cast("int")
    first = staged(_searched(blocks, queries.withColumn("least", F.lit(None).cast("long")).withColumn("least_id", F.lit(None).cast("long")).withColumn("shard", own), ["shard"], k), "first")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    kth = first.where("vec_id is not null").withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"), F.col("vec_id").alias("least_id"))
    groups = max(1, -(-n_queries // vectors.GROUP))
    others = (
        queries.join(sized(kth, n_queries), "vec_id", "left")
        .withColumn("grp", F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(groups)).cast("int"))
        .withColumn("shard", F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != own)))
    )
    spread = blocks.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return first.unionByName(_searched(spread, others, ["shard", "grp"], k))


def top(embeddings: DataFrame, k: int = vectors.TOP) -> DataFrame:
    """Return query_id, rank, vec_id, score: the ``k`` largest integer inner products of each query row.

    Needs vec_id and embedding (an array of floats or doubles). Rows with a null id, a null vector or a
    null or non-finite component take no part. A row is no candidate for a query of its own id; other
    rows that repeat an id are candidates each, and query rows that repeat one are one query, which gets
    the best of their answers. Shorter vectors count as filled with zeros; zero and empty vectors score 0.
    Ties go to the smaller vec_id. Sums beyond a long are held at its ends. With no queries or a single
    row the result is empty. Other columns are ignored.
    """
    return vectors.ranked(_found(embeddings, k).where("vec_id is not null").select("query_id", "vec_id", "score"), k)


def pruning(embeddings: DataFrame, k: int = vectors.TOP) -> DataFrame:
    """Return query_id, blocks, scored: out of how many blocks a query scored how many."""
    return _found(embeddings, k).where("vec_id is null").groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum("score").alias("scored"))


def op3_topk(spark, sf_dir: str) -> DataFrame:
    return top(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_inner_product(q.w, d.w)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 20
"""
