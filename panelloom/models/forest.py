"""Scores of all nested settings of a forest from one fit.

A tree that may grow deep holds the trees of less depth: rows stop at the node
of that depth and take its label shares. The first trees of a forest are a
forest of fewer trees. One fit of the largest setting therefore scores all
others; forests fitted apart differ by their random draws, and by leaves that
Spark merges where both say the same label.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.models import fleet
from panelloom.models.fleet import count_confusion
from panelloom.session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Grown:
    """A tree as arrays over its nodes; a leaf has no feature and leads to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    shares: np.ndarray


def trees_of(model: Model, spark) -> list[Grown]:
    """The nodes of a fitted forest, read from its saved form in the shared folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # the model, which the driver holds anyway
    by_tree: dict[int, list] = {}
    for r in rows:
        by_tree.setdefault(r["treeID"], []).append(r)
    out = []
    for number in sorted(by_tree):
        nodes = sorted(by_tree[number], key=lambda r: r["id"])
        inner = [r["leftChild"] >= 0 for r in nodes]
        stats = np.array([r["impurityStats"] for r in nodes], float)
        out.append(
            Grown(
                np.array([r["split"]["featureIndex"] if i else -1 for r, i in zip(nodes, inner)]),
                np.array([r["split"]["leftCategoriesOrThreshold"][0] if i else 0.0 for r, i in zip(nodes, inner)]),
                np.array([r["leftChild"] if i else r["id"] for r, i in zip(nodes, inner)]),
                np.array([r["rightChild"] if i else r["id"] for r, i in zip(nodes, inner)]),
                stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300),
            )
        )
    return out


def nested_codes(trees: Sequence[Grown], x: np.ndarray, sizes: Sequence[int], depths: Sequence[int | None]) -> dict[tuple[int, int | None], np.ndarray]:
    """Codes of filled rows for every number of trees and every depth, None for no limit."""
    votes = {d: np.zeros((len(x), trees[0].shares.shape[1])) for d in depths}
    rows, out = np.arange(len(x)), {}
    for number, tree in enumerate(trees, 1):
        at, level = np.zeros(len(x), int), 0
        while True:
            if level in votes:
                votes[level] += tree.shares[at]
            feature = tree.feature[at]
            if (feature < 0).all():
                break
            # A leaf leads to itself, whichever way.
            at = np.where(x[rows, feature] <= tree.cut[at], tree.left[at], tree.right[at])
            level += 1
        for d in depths:
            if d is None or d > level:
                votes[d] += tree.shares[at]
        if number in sizes:
            out |= {(number, d): v.argmax(axis=1) for d, v in votes.items()}
    return out


def largest(candidates: Sequence[dict]) -> dict:
    """The setting that holds all others."""
    depths = [p["max_depth"] for p in candidates]
    return {"n_estimators": max(p["n_estimators"] for p in candidates), "max_depth": None if None in depths else max(depths)}


def nested_scores(model: Model, candidates: Sequence[dict], check: DataFrame, classes: int) -> list[float]:
    """Macro-F1 of every candidate on rows (features, label_index), from a forest of the largest setting."""
    trees = trees_of(model, check.sparkSession)
    sizes, depths = sorted({p["n_estimators"] for p in candidates}), list({p["max_depth"]: 0 for p in candidates})
    keys = [(p["n_estimators"], p["max_depth"]) for p in candidates]

    def count(batches):
        for batch in batches:
            said = nested_codes(trees, np.stack(batch["x"].to_numpy()).astype(float), sizes, depths)
            y = batch["y"].to_numpy().astype(int)
            cells = np.concatenate([count_confusion(y, said[k], classes).ravel() for k in keys])
            yield pd.DataFrame({"cell": np.arange(len(cells)), "n": cells})

    rows = check.select(vector_to_array("features").alias("x"), F.col("label_index").alias("y"))
    counted = rows.mapInPandas(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(len(keys) * classes * classes)
    for r in counted:
        cells[r["cell"]] = r["n"]
    return [fleet.macro_f1(c) for c in cells.reshape(len(keys), classes, classes)]
