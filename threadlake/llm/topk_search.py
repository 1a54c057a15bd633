"""Exact top-k inner products by no-random-access aggregation.

Every dimension of the vectors is a list sorted by value.  A query reads each list
sequentially from the end that is best for it: from the largest value down where
its own component is positive, from the smallest up where it is negative.  After
a round of reading, the score of a vector lies between a lower bound, which takes
the worst value of a list for what has not been read, and an upper bound, which
takes the list's frontier, the last value read.  Once the vectors whose upper
bound reaches the k-th best lower bound are few, no outsider can qualify and
reading stops; the final scores of those few are computed exactly.  Where the
lists are read to their ends the bounds meet in the score.

The work is cut into tiles of a shard of vectors and a block of queries, both of
bounded expected size and dealt by the hash of the id.  Spark forms the tiles by a shuffle
(vectors once per block, queries once per shard); inside a tile all queries read
their lists in step, a block of entries at a time.  A tile returns k rows per query
and a last window merges the shards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.session import materialize

SCALE = 256
TOP = 5
QUERY_STEP = 50

#: Expected vectors and queries of a tile.
SHARD_ROWS = 4096
BLOCK_QUERIES = 512

#: Shares of each list that have been read after a round.
DEPTHS = (0.5, 0.875, 1.0)

#: A query stops reading when at most so many times k vectors can still qualify.
FEW = 12


def _number_type(vectors: np.ndarray, queries: np.ndarray) -> type:
    """The fastest type that holds every partial sum exactly."""
    if not vectors.size or not queries.size:
        return np.float64
    most = int(np.abs(vectors).max()) * int(np.abs(queries).max()) * vectors.shape[1]
    if most < 1 << 53:
        return np.float64
    return np.int64 if most < 1 << 62 else object


def nra_tile(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best vectors of a tile for each query: query ids, vector ids, scores."""
    kind = _number_type(vectors, queries)
    lists = np.sort(vectors, axis=0).astype(kind)
    vectors, queries = vectors.astype(kind), queries.astype(kind)
    rising, falling = np.maximum(queries, 0), np.minimum(queries, 0)
    n, found = len(ids), []
    active, alive = np.arange(len(query_ids)), np.arange(n)
    for share in DEPTHS:
        if not len(active) or not n:
            break
        depth = max(1, math.ceil(n * share))
        top, bottom = lists[n - depth], lists[depth - 1]
        x, up, down = vectors[alive], rising[active], falling[active]
        # What is above the frontier has been read; the rest lies between frontier and worst value.
        upper = np.maximum(x, top) @ up.T + np.minimum(x, bottom) @ down.T
        lower = np.where(x >= top, x, lists[0]) @ up.T + np.where(x <= bottom, x, lists[-1]) @ down.T
        own = ids[alive][:, None] == query_ids[active][None, :]
        others = ~own
        # A query's own row must not count among its k best lower bounds.
        lowest = lower.min() - 1 if lower.size else 0
        lower = np.where(own, lowest, lower)
        if len(alive) > k:
            bar = np.partition(lower, len(alive) - k, axis=0)[len(alive) - k]
            open_ = (upper >= bar) & others
        else:
            open_ = others
        few = open_.sum(axis=0) <= FEW * k if share < 1 else np.ones(len(active), bool)
        rows, cols = np.nonzero(open_ & few)
        if share < 1:
            scores = np.array(
                [s for at in range(0, len(rows), 4096) for s in (x[rows[at : at + 4096]] * queries[active[cols[at : at + 4096]]]).sum(axis=1)],
                dtype=kind,
            )
        else:
            scores = upper[rows, cols]
        found.append((active[cols], alive[rows], scores))
        rest = open_[:, ~few].any(axis=1)
        active, alive = active[~few], alive[rest]
    if not found:
        return query_ids[:0], ids[:0], np.zeros(0, np.int64)
    who, what, score = (np.concatenate(part) for part in zip(*found))
    if kind is object:
        score = np.array([int(s) for s in score], object)
    else:
        score = score.astype(np.int64)
    order = np.lexsort((ids[what], -score, who)) if kind is not object else np.array(
        sorted(range(len(who)), key=lambda i: (who[i], -score[i], ids[what[i]])), dtype=np.int64
    )
    who, what, score = who[order], what[order], score[order]
    first = np.searchsorted(who, who, side="left")
    best = np.arange(len(who)) - first < k
    return query_ids[who[best]], ids[what[best]], score[best]


def quantise(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """``(vec_id, values)`` with ``floor(scale * x)`` for every component."""
    kept = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x")
    ).filter(
        F.col("vec_id").isNotNull()
        & F.col("x").isNotNull()
        # Null for a null component, so the comparison keeps it out as well.
        & F.coalesce(F.forall("x", lambda c: F.abs(c) < F.lit(float("inf"))), F.lit(False))
        & F.forall("x", lambda c: c.isNotNull())
    )
    return kept.select(
        "vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("values")
    )


def top_k(
    vectors: DataFrame,
    k: int = TOP,
    query_step: int = QUERY_STEP,
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the ids divisible by ``query_step``.

    ``vectors`` is ``(vec_id, values)`` as ``quantise`` makes it, where rows with a
    null id, a null vector or a null or non-finite component are left out.  Rows
    that repeat an id count once, with the vector that sorts first.  Vectors of
    another length than a query's take no part in its search.  Ties go to the
    smaller id; fewer than ``k`` candidates are all returned; no vectors, no rows.
    Scores must fit a long.
    """
    spark = vectors.sparkSession
    once = materialize(
        vectors.groupBy("vec_id").agg(F.min("values").alias("values")), "search-vectors"
    )
    total = once.count()
    shards = max(1, math.ceil(total / shard_rows))
    blocks = max(1, math.ceil(total / query_step / block_queries))
    own_shard = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards))
    own_block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    dim = F.size("values").alias("dim")
    lists = once.select("vec_id", "values", dim, own_shard.alias("shard"), every(blocks).alias("block"))
    asked = once.filter(F.col("vec_id") % query_step == 0).select(
        "vec_id", "values", dim, every(shards).alias("shard"), own_block.alias("block")
    )

    def matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = rows.column("vec_id").to_numpy()
        flat = rows.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return ids, flat.reshape(len(ids), len(flat) // max(1, len(ids)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            query_ids, vec_ids, scores = nra_tile(*matrix(left), *matrix(right), k)
        else:
            query_ids = vec_ids = scores = np.zeros(0, np.int64)
        columns = [pa.array(c.tolist(), pa.int64()) for c in (query_ids, vec_ids, scores)]
        return pa.Table.from_arrays(columns, ["query_id", "vec_id", "score"])

    tile = ("dim", "shard", "block")
    found = (
        lists.groupBy(*tile)
        .cogroup(asked.groupBy(*tile))
        .applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def top_k_query(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return top_k(quantise(vectors))


ORACLE = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.c, d.c)]) AS BIGINT) AS score
  FROM v q JOIN v d ON d.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
