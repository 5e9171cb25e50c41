"""Exact nearest neighbours as a partitioned join.

Training rows are grouped around their nearest pivots, once each.  In a first
pass a query meets its own group only, which gives it a radius that certainly
holds k neighbours.  In the second it visits those other groups that reach into
the radius: neither their ring of distances around the pivot nor the plane that
separates the pivots may keep them outside (after Lu et al., "Efficient
processing of k nearest neighbor joins using MapReduce", VLDB 2012).  Groups are
cut into blocks of limited size on both sides, whatever their population; a task
compares one pair of blocks and returns k rows per query, so the pairs
themselves are never materialised.

Distances in many dimensions are alike and hardly leave a group out: of 64
unstructured dimensions nearly all pairs are compared.

Equal vectors are one point. Of its training rows only the first k can be
neighbours, and its queries share one search, so rows whose values are all
missing do not meet each other by the thousand.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelloom.functions import ordering
from panelloom.session import cut_lineage
from panelloom.spec import SEED

# Functions below run in Python workers, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Query rows per block; training blocks are larger, since every training block
# returns k rows for every query it meets.
BLOCK_ROWS = 1024
TRAIN_BLOCK_FACTOR = 8
TASKS_PER_CORE = 4
# Pivots travel in closures, with a matrix of their distances (8 MB). A table too
# large for so many small groups gets larger ones, which are cut into more blocks.
MOST_PIVOTS = 1024


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances by direct differences, a slice of points at a time."""
    out = np.empty((len(points), len(centres)))
    step = max(1, 4_000_000 // max(1, centres.size))
    for start in range(0, len(points), step):
        part = points[start : start + step, None, :] - centres[None, :, :]
        out[start : start + step] = np.sqrt(np.einsum("ijk,ijk->ij", part, part))
    return out


def _nearest(points: np.ndarray, centres: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column numbers and distances of the k nearest centres of each point, ties by column.

    Products of matrices rule out what is too far by more than their rounding;
    what is left is measured by direct differences, so results are those of
    ``_distances``.
    """
    if len(centres) <= k or not (np.isfinite(points).all() and np.isfinite(centres).all()):
        d = _distances(points, centres)
        rows, columns = _nearest_columns(d, k)
        return rows, columns, d[rows, columns]
    p2, c2 = np.einsum("ij,ij->i", points, points), np.einsum("ij,ij->i", centres, centres)
    slack = 16 * (points.shape[1] + 8) * np.finfo(float).eps * (p2 + c2.max())
    found: list[list[np.ndarray]] = [[], [], []]
    step = max(1, 4_000_000 // len(centres))
    for start in range(0, len(points), step):
        part = slice(start, start + step)
        squares = c2 - 2 * (points[part] @ centres.T)
        limit = np.partition(squares, k - 1, axis=1)[:, k - 1] + slack[part]
        rows, columns = np.nonzero(squares <= limit[:, None])
        apart = points[part][rows] - centres[columns]
        d = np.sqrt(np.einsum("ij,ij->i", apart, apart))
        order = np.lexsort((columns, d, rows))
        rows, columns, d = rows[order], columns[order], d[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
        for column, values in zip(found, (rows[kept] + start, columns[kept], d[kept])):
            column.append(values)
    return tuple(np.concatenate(f) if f else np.empty(0, int) for f in found)


def _nearest_columns(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k smallest entries of each row, ties by column."""
    if d.shape[1] > k:
        limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        rows, columns = np.nonzero(d <= limit)
    else:
        rows, columns = np.indices(d.shape).reshape(2, -1)
    order = np.lexsort((columns, d[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    return rows[place < k], columns[place < k]


@dataclass(frozen=True)
class _Geometry:
    """What the driver keeps: a few numbers per pivot."""

    pivots: np.ndarray
    near: np.ndarray  # smallest distance of a training row of the group to its pivot
    far: np.ndarray  # largest distance
    kth: np.ndarray  # distance from the pivot to its k-th nearest training row


def _choose_pivots(train: DataFrame, train_id: str, vector: str, count: int) -> np.ndarray:
    spread = ordering.hash_order(F.lit(SEED), F.col(train_id))
    rows = train.orderBy(spread).limit(count).select(vector).collect()
    return np.unique(np.array([r[0] for r in rows], dtype=float), axis=0)


def _with_cell(rows: DataFrame, vector: str, pivots: np.ndarray) -> DataFrame:
    @F.pandas_udf("struct<cell:int,distance:double>")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        d = _distances(np.stack(vectors.to_numpy()).astype(float), pivots)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "distance": d[np.arange(len(d)), cell]})

    return rows.withColumn("_near", nearest(vector))


def _kth_nearest_to_pivots(train: DataFrame, vector: str, pivots: np.ndarray, k: int) -> np.ndarray:
    """Distance from each pivot to its k-th nearest training row."""
    schema = "pivot int, distance double"

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.empty((len(pivots), 0))
        for batch in batches:
            d = _distances(np.stack(batch[vector].to_numpy()).astype(float), pivots).T
            kept = np.sort(np.concatenate([kept, d], axis=1), axis=1)[:, :k]
        yield pd.DataFrame(
            {"pivot": np.repeat(np.arange(len(pivots), dtype="int32"), kept.shape[1]), "distance": kept.ravel()}
        )

    # k rows per pivot and partition arrive at the ranking.
    place = Window.partitionBy("pivot").orderBy("distance")
    rows = (
        train.select(vector)
        .mapInPandas(best, schema)
        .withColumn("place", F.row_number().over(place))
        .where(F.col("place") <= k)
        .groupBy("pivot")
        .agg(F.max("distance").alias("distance"))
        .collect()
    )
    kth = np.full(len(pivots), np.inf)
    for row in rows:
        kth[row.pivot] = row.distance
    return kth


def _geometry(training: DataFrame, vector: str, k: int, pivots: np.ndarray) -> tuple[_Geometry, dict[int, int]]:
    """Rings around the pivots, and training rows by group."""
    stats = (
        training.groupBy("_near.cell")
        .agg(
            F.min("_near.distance").alias("near"),
            F.max("_near.distance").alias("far"),
            F.count("*").alias("n"),
        )
        .collect()
    )
    near, far = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for row in stats:
        near[row.cell], far[row.cell] = row.near, row.far
    kth = _kth_nearest_to_pivots(training, vector, pivots, k)
    return _Geometry(pivots, near, far, kth), {r.cell: r.n for r in stats}


def _with_visits(queries: DataFrame, vector: str, geometry: _Geometry) -> DataFrame:
    """Other groups that may hold one of a query's neighbours, column ``visits``.

    ``kth`` is the k-th best distance in the query's own group, if it has one.
    """
    g = geometry
    between = _distances(g.pivots, g.pivots)

    @F.pandas_udf("array<int>")
    def reachable(vectors: pd.Series, cell: pd.Series, distance: pd.Series, kth: pd.Series) -> pd.Series:
        d = _distances(np.stack(vectors.to_numpy()).astype(float), g.pivots)
        own, home = cell.to_numpy(), distance.to_numpy()
        radius = np.fmin(kth.to_numpy(dtype=float), home + g.kth[own])[:, None]
        radius = radius + 1e-9 * (1.0 + np.abs(np.where(np.isfinite(radius), radius, 0.0)))
        ring = np.maximum(d - g.far, g.near - d) <= radius
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d**2 - home[:, None] ** 2) / (2 * between[own])
        hits = ring & ~(plane > radius) & np.isfinite(g.near)
        hits[np.arange(len(own)), own] = False
        return pd.Series([np.flatnonzero(h).astype("int32") for h in hits])

    return queries.withColumn("visits", reachable(vector, "_near.cell", "_near.distance", "kth"))


def nearest_neighbours(
    train: DataFrame,
    test: DataFrame,
    k: int,
    train_id: str,
    test_id: str,
    vector: str = "features",
    carry: str | None = None,
    pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """k nearest training rows of every test row by Euclidean distance.

    Ids are unique; equal distances are ordered by training id.  Returns
    (test_id, neighbour, distance, place[, carry]), place counting from 1.
    """
    given = train.select(F.col(train_id).alias("neighbour"), F.col(vector).alias("vector"), *([F.col(carry).alias("carry")] if carry else []))
    asked = cut_lineage(test.select(F.col(test_id).alias("query"), F.col(vector).alias("vector")))
    first = F.row_number().over(Window.partitionBy("vector").orderBy("neighbour"))
    points = cut_lineage(given.withColumn("_first", first).where(F.col("_first") <= k).drop("_first"))
    if pivots is None:
        pivots = int(min(MOST_PIVOTS, max(4, points.count() ** 0.5 / 4)))
    centres = _choose_pivots(points, "neighbour", "vector", pivots)
    training = cut_lineage(_with_cell(points, "vector", centres))
    geometry, sizes = _geometry(training, "vector", k, centres)
    queries = cut_lineage(_with_cell(asked.groupBy("vector").agg(F.min("query").alias("query")), "vector", centres))

    # Few rows, k per query, and read twice: for the radius and for the result.
    home = cut_lineage(_compared(queries.withColumn("cell", F.col("_near.cell")), training, sizes, k, block_rows))
    reached = home.groupBy("query").agg(F.when(F.count("*") >= k, F.max("distance")).alias("kth"))
    visiting = cut_lineage(_with_visits(queries.join(reached, "query", "left"), "vector", geometry))
    away = _compared(
        visiting.select("query", "vector", F.explode("visits").alias("cell")), training, sizes, k, block_rows
    )
    place = Window.partitionBy("query").orderBy("distance", "neighbour")
    ranked = home.unionByName(away).withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)
    # A point's k rows reach all its queries; the other side has one row per point.
    columns = ["neighbour", "distance", *(["carry"] if carry else []), "place"]
    answers = ranked.groupBy("query").agg(F.collect_list(F.struct(*columns)).alias("_found"))
    by_point = queries.select("query", "vector").join(answers, "query").drop("query")
    told = asked.join(by_point, "vector").select("query", F.inline("_found"))
    return told.withColumnsRenamed({"query": test_id, **({"carry": carry} if carry else {})})


def _compared(queries: DataFrame, training: DataFrame, sizes: dict[int, int], k: int, block_rows: int) -> DataFrame:
    """(query, neighbour, distance[, carry]): k best of each query (query, vector, cell) in its group.

    Each block of a group's queries meets each block of its training rows.
    """
    train_sizes = {c: -(-n // (block_rows * TRAIN_BLOCK_FACTOR)) for c, n in sizes.items()}
    counted = queries.groupBy("cell").agg(F.count("*").alias("n")).collect()  # a row per pivot
    query_sizes = {r["cell"]: -(-r["n"] // block_rows) for r in counted}

    def blocks(counts: dict[int, int]) -> Column:
        pieces = [x for c, n in counts.items() for x in (F.lit(int(c)), F.lit(int(n)))]
        return F.create_map(*pieces).cast("map<int,int>")

    tables = {"q": blocks(query_sizes), "t": blocks(train_sizes)}
    part = lambda column, cell, table: F.pmod(F.xxhash64(column), tables[table][cell]).cast("int")
    every = lambda cell, table: F.explode(F.sequence(F.lit(0), tables[table][cell] - 1))
    own = F.col("cell")
    left = queries.where(tables["t"][own] > 0).select(
        "query", "vector", "cell", part("query", own, "q").alias("qb"), every(own, "t").alias("tb")
    )
    right = (
        training.withColumn("cell", F.col("_near.cell"))
        .drop("_near")
        .where(tables["q"][own] > 0)
        .withColumns({"tb": part("neighbour", own, "t"), "qb": every(own, "q")})
    )
    fields = {f.name: f.dataType for f in [*left.schema.fields, *right.schema.fields]}
    carry = "carry" in fields
    out = T.StructType(
        [T.StructField("query", fields["query"]), T.StructField("neighbour", fields["neighbour"])]
        + [T.StructField("distance", T.DoubleType())]
        + ([T.StructField("carry", fields["carry"])] if carry else [])
    )

    def compare(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or candidates.empty:
            return pd.DataFrame({f.name: [] for f in out.fields})
        candidates = candidates.sort_values("neighbour", kind="stable", ignore_index=True)
        rows, flat, d = _nearest(
            np.stack(queries["vector"].to_numpy()).astype(float), np.stack(candidates["vector"].to_numpy()).astype(float), k
        )
        found = {
            "query": queries["query"].to_numpy()[rows],
            "neighbour": candidates["neighbour"].to_numpy()[flat],
            "distance": d,
        }
        if carry:
            found["carry"] = candidates["carry"].to_numpy()[flat]
        return pd.DataFrame(found)

    grid = ["cell", "qb", "tb"]
    # The work is in the pairs, not in the bytes by which Spark would join up tasks.
    met = sum(n * query_sizes.get(c, 0) for c, n in train_sizes.items())
    tasks = max(1, min(TASKS_PER_CORE * queries.sparkSession.sparkContext.defaultParallelism, met))
    left, right = (side.repartition(tasks, *grid) for side in (left, right))
    return left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInPandas(compare, out)


def vote(neighbours: DataFrame, test_id: str, label: str, out: str = "prediction") -> DataFrame:
    """Most frequent label among the neighbours, the first in order on a tie."""
    counts = neighbours.groupBy(test_id, label).agg(F.count("*").alias("n"))
    return counts.groupBy(test_id).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(out))


class NearestNeighbourClassifier(Estimator):
    def __init__(self, k: int = 5, features: str = "features", label: str = "label_index") -> None:
        super().__init__()
        self.k, self.features, self.label = k, features, label

    def _fit(self, dataset: DataFrame) -> "NearestNeighbourModel":
        return NearestNeighbourModel(dataset.select("row_id", self.features, self.label), self.k, self.features, self.label)


class NearestNeighbourModel(Model):
    """Needs a unique ``row_id`` on the rows to classify."""

    def __init__(self, train: DataFrame, k: int, features: str, label: str) -> None:
        super().__init__()
        self.train, self.k, self.features, self.label = train, k, features, label

    def neighbours(self, dataset: DataFrame) -> DataFrame:
        def as_array(frame: DataFrame, *others: str) -> DataFrame:
            return frame.select("row_id", vector_to_array(self.features).alias("vector"), *others)

        return nearest_neighbours(
            as_array(self.train, self.label), as_array(dataset), self.k, "row_id", "row_id", "vector", self.label
        )

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.join(vote(self.neighbours(dataset), "row_id", self.label), "row_id", "left")


def nested_scores(candidates: list[dict], train: DataFrame, check: DataFrame) -> list[DataFrame]:
    """Predictions of every number of neighbours from one search for the most of them."""
    model = NearestNeighbourModel(train.select("row_id", "features", "label_index"), max(p["n_neighbors"] for p in candidates), "features", "label_index")
    found = cut_lineage(model.neighbours(check))
    return [check.join(vote(found.where(F.col("place") <= p["n_neighbors"]), "row_id", "label_index"), "row_id", "left") for p in candidates]
