"""Exact top-k by integer inner product, pruned by segment statistics.

With whole numbers q and x, |q - x|^2 = |q|^2 + |x|^2 - 2 q.x, so a lower bound
of the distance is an upper bound of the product. For vectors cut into segments
of length L with means m and deviations s, |q - x|^2 is at least the sum over
segments of L ((mq - mx)^2 + (sq - sx)^2), hence q.x is at most the sum of
L (mq mx + sq sx). Bounds go from few long segments to many short ones; only
pairs whose bound reaches the k-th best score so far get the exact product.

Queries and candidates are dealt into blocks; a task takes one pair of blocks
and returns k rows per query. Candidates are copied once per block of queries.

Edge cases: vectors that are null or hold a null or non-finite component take
no part, nor do rows without a vec_id. Vectors of different lengths are not
compared. Rows that share a vec_id are separate candidates of other queries; as
queries they are one, the first by vector order, and none of them is its own
candidate. Scores beyond a long are cut to its range.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelloom.llm.common import cut_lineage, read

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 5
SCALE = 256
EVERY = 50
QUERY_BLOCK = 4_096
CANDIDATE_BLOCK = 16_384
STRIP = 256  # candidates looked at together
PAIRS = 1 << 15  # pairs of vectors laid side by side, which bounds a task's memory
DENSE = 1 / 16  # of a strip's pairs; if more are left, one matrix product for all costs less
SEGMENTS = (4, 16)
RESULT = "query_id bigint, vec_id bigint, score bigint"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, components as doubles."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    )


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of its length."""
    parts = np.array_split(x, min(segments, max(1, x.shape[1])), axis=1)
    root = [math.sqrt(p.shape[1]) for p in parts]
    means = [p.mean(axis=1) * r if p.shape[1] else p.sum(axis=1) for p, r in zip(parts, root)]
    spread = [p.std(axis=1) * r if p.shape[1] else p.sum(axis=1) for p, r in zip(parts, root)]
    return np.stack([*means, *spread], axis=1)


def _products(q: np.ndarray, x: np.ndarray, asked: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, by a matrix product of all rows or a bounded number of pairs at a time."""
    if len(asked) > DENSE * len(q) * len(x):
        return (q @ x.T)[asked, seen]
    out = np.empty(len(asked))
    for at in range(0, len(asked), PAIRS):
        part = slice(at, at + PAIRS)
        out[part] = np.einsum("ij,ij->i", q[asked[part]], x[seen[part]])
    return out


def best(query_ids, q, ids, x, k: int):
    """Rows (query, candidate id, score) of the k best per query, with ties to the smaller id."""
    largest = max(1.0, float(np.abs(q).max(initial=0)), float(np.abs(x).max(initial=0)))
    exact = largest * largest * max(1, q.shape[1]) < 2**52
    levels = [(statistics(q, s), statistics(x, s)) for s in SEGMENTS]
    slack = 1e-9 * largest * largest * max(1, q.shape[1]) + 1e-6
    top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object if not exact else np.float64))
    reach = np.full(len(q), -np.inf)
    for at in range(0, len(x), STRIP):
        end = min(at + STRIP, len(x))
        (cq, cx), finer = levels[0], levels[1:]
        asked, seen = np.nonzero(cq @ cx[at:end].T + slack >= reach[:, None])
        for fq, fx in finer:
            keep = _products(fq, fx[at:end], asked, seen) + slack >= reach[asked]
            asked, seen = asked[keep], seen[keep]
        if exact:
            score = _products(q, x[at:end], asked, seen)
            near = score >= reach[asked]
            asked, seen, score = asked[near], seen[near], score[near]
        seen = seen + at
        other = query_ids[asked] != ids[seen]
        asked, seen = asked[other], seen[other]
        if exact:
            score = score[other]
        else:
            score = np.array([sum(int(a) * int(b) for a, b in zip(q[i], x[j])) for i, j in zip(asked, seen)], object)
        asked, seen, score = (np.concatenate(pair) for pair in zip(top, (asked, seen, score)))
        order = np.lexsort((ids[seen], (-score).astype(np.float64) if exact else -score, asked))
        asked, seen, score = asked[order], seen[order], score[order]
        first = np.searchsorted(asked, asked, "left")
        keep = np.arange(len(asked)) - first < k
        top = asked[keep], seen[keep], score[keep]
        number = np.bincount(top[0], minlength=len(q))
        full = np.flatnonzero(number == k)
        last = np.cumsum(number) - 1
        reach[full] = top[2][last[full]].astype(np.float64)
    asked, seen, score = top
    low, high = -(2**63), 2**63 - 1
    return query_ids[asked], ids[seen], [min(high, max(low, int(s))) for s in score]


def _blocks(k: int):
    def search(key, queries, candidates):
        out = ([], [], [])

        def by_length(table):
            table = table.combine_chunks()
            lengths = pc.list_value_length(table["v"]).to_numpy().astype(np.int64)
            ids = table["vec_id"].to_numpy()
            flat = table["v"].combine_chunks().flatten().to_numpy() if table.num_rows else np.zeros(0)
            ends = np.cumsum(lengths)
            for d in np.unique(lengths):
                rows = np.flatnonzero(lengths == d)
                index = (ends[rows] - d)[:, None] + np.arange(d)[None, :]
                yield int(d), ids[rows], np.floor(flat[index] * SCALE)

        right = {d: (ids, x) for d, ids, x in by_length(candidates)}
        for d, ids, q in by_length(queries):
            if d in right:
                for column, values in zip(out, best(ids, q, *right[d], k)):
                    column.extend(values)
        return pa.table([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other vectors of each query."""
    asked = whole_vectors(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = cut_lineage(asked)
    there = whole_vectors(vectors)
    query_blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    blocks = max(1, math.ceil(there.count() / CANDIDATE_BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(deal(query_blocks).alias("qb"), every(blocks).alias("cb"), "vec_id", "v")
    right = there.select(every(query_blocks).alias("qb"), deal(blocks).alias("cb"), "vec_id", "v")
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(_blocks(k), RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op9_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE = f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rank
  FROM whole AS q JOIN whole AS c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % {EVERY} = 0
) WHERE rank <= {K}
"""
