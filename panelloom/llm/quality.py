"""Quality by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1 outside the held-out fold; the
unlabelled texts are all documents. No label 0 is used. With the logistic loss
the unbiased risk is

    prior * E_pos[l(f)] + (E_all[l(-f)] - prior * E_pos[l(-f)])

whose second part estimates the risk on negatives. It is minimised by Newton
steps over all documents; whenever its estimate falls below zero, the step
instead raises it again, so that it is never driven negative.

The class prior is estimated from a first classifier that only tells positives
from all documents: where its scores are high, positives and all documents
differ by the prior alone, so the least ratio of their tails is taken.

Features depend on the text alone: shares of character classes and of pairs of
classes, and statistics of words and lines.

Edge cases: null and empty texts have zero features and get a score like any
other. A document with several label rows is positive if one says so. Without
any positive all scores are 0. Rows repeated whole keep their number.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import cut_lineage, held_out, identified, read

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PREDICT = 0.3
STEPS = 16
RIDGE = 1e-5
BINS = 200  # of scores, for the prior
LEAST_TAIL = 0.3  # of the positives, in the tails that estimate the prior

# Classes of bytes: lower case, upper case, digit, blank, line end, full stop and
# comma, other sentence marks, other signs, bytes above ASCII.
CLASSES = 9
FEATURES = CLASSES * CLASSES + CLASSES + 9


def _classes() -> np.ndarray:
    table = np.full(256, 7, np.uint8)
    table[97:123], table[65:91], table[48:58] = 0, 1, 2
    table[[9, 11, 12, 13, 32]], table[10] = 3, 4
    table[[44, 46]] = 5
    table[[33, 34, 39, 40, 41, 45, 58, 59, 63]] = 6
    table[128:] = 8
    return table


def describe(data: bytes, table: np.ndarray) -> np.ndarray:
    """Features of one text, all of them bounded."""
    out = np.zeros(FEATURES, np.float32)
    if not data:
        return out
    kinds = table[np.frombuffer(data, np.uint8)]
    pairs = np.bincount(kinds[:-1].astype(np.int64) * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
    shares = np.bincount(kinds, minlength=CLASSES) / len(kinds)
    out[: CLASSES * CLASSES] = np.sqrt(pairs / max(1, len(kinds) - 1))
    out[CLASSES * CLASSES : CLASSES * (CLASSES + 1)] = np.sqrt(shares)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x]
    at = CLASSES * (CLASSES + 1)
    if words:
        distinct = len(set(words))
        same = sum(map(bytes.__eq__, words, words[1:])) / len(words)
        length = sum(map(len, words)) / len(words)
        out[at : at + 6] = (
            distinct / len(words),
            math.log(distinct) / math.log(len(words) + 1),
            math.sqrt(same),
            min(length, 40) / 10,
            math.log(len(words)) / 10,
            min(1.0, max(map(len, words)) / 100),
        )
    if lines:
        out[at + 6 : at + 9] = (
            1 - len(set(lines)) / len(lines),
            min(20.0, len(words) / len(lines)) / 20,
            math.log(len(lines)) / 10,
        )
    return out


def _describe(batches):
    table = _classes()
    for batch in batches:
        rows = [describe(t.as_py(), table).tobytes() for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "x"])


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features as packed floats."""
    return identified(docs).select("doc_id", "text").mapInArrow(_describe, "doc_id bigint, x binary")


def _design(batch: pa.RecordBatch) -> np.ndarray:
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, FEATURES)
    return np.hstack([np.ones((len(x), 1)), x]).astype(np.float64)


def _positive(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def _sums(weight: np.ndarray):
    """One row per task: what a Newton step needs, summed over its documents.

    In order: documents, positives, losses of both as negatives, gradients of
    both, the positives' features, the curvature of both.
    """
    d = FEATURES + 1

    def run(batches):
        total = np.zeros(4 + 3 * d + 2 * d * d)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, positive = _design(batch), _positive(batch)
            z = x @ weight
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            pos = x[positive]
            curve, curve_pos = (x.T * (p * (1 - p))) @ x, (pos.T * (p * (1 - p))[positive]) @ pos
            total += np.concatenate(
                [
                    [len(x), len(pos), _softplus(z).sum(), _softplus(z[positive]).sum()],
                    p @ x, p[positive] @ pos, pos.sum(axis=0), curve.ravel(), curve_pos.ravel(),
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "value"]
        )

    return run


def _collect_sums(rows: DataFrame, weight: np.ndarray) -> dict[str, np.ndarray]:
    d = FEATURES + 1
    table = rows.mapInArrow(_sums(weight), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(4 + 3 * d + 2 * d * d)
    total[table["at"].to_numpy()] = table["value"].to_numpy()
    n, pos = max(1.0, total[0]), max(1.0, total[1])
    vectors, curves = total[4 : 4 + 3 * d].reshape(3, d), total[4 + 3 * d :].reshape(2, d, d)
    return {
        "n": total[0], "positives": total[1], "loss_all": total[2] / n, "loss_pos": total[3] / pos,
        "grad_all": vectors[0] / n, "grad_pos": vectors[1] / pos, "mean_pos": vectors[2] / pos,
        "curve_all": curves[0] / n, "curve_pos": curves[1] / pos,
    }


def minimise(rows: DataFrame, prior: float, contrast: bool = False) -> np.ndarray:
    """Weights of the least non-negative risk met on the way.

    With ``contrast`` the loss instead tells positives from all documents, each
    side with half the weight, for the estimate of the prior.
    """
    weight, penalty = np.zeros(FEATURES + 1), np.full(FEATURES + 1, RIDGE)
    penalty[0] = 1e-8
    best, least = weight, math.inf
    for _ in range(STEPS):
        s = _collect_sums(rows, weight)
        if contrast:
            risk = s["loss_all"] + s["loss_pos"] - s["mean_pos"] @ weight
        else:
            risk = prior * (s["loss_pos"] - s["mean_pos"] @ weight) + max(0.0, s["loss_all"] - prior * s["loss_pos"])
        if risk < least:
            best, least = weight, risk
        if contrast:
            grad = 0.5 * s["grad_all"] + 0.5 * (s["grad_pos"] - s["mean_pos"]) + penalty * weight
            curve = 0.5 * s["curve_all"] + 0.5 * s["curve_pos"]
        elif s["loss_all"] - prior * s["loss_pos"] >= 0:
            # prior * E_pos[l(f) - l(-f)] = -prior * E_pos[f]: the risk is convex.
            grad = s["grad_all"] - prior * s["mean_pos"] + penalty * weight
            curve = s["curve_all"]
        else:
            grad = -(s["grad_all"] - prior * s["grad_pos"])
            curve = s["curve_all"] + prior * s["curve_pos"]
        step = np.linalg.solve(curve + np.diag(penalty + 1e-9), grad)
        longest = np.abs(step).max()
        weight = weight - step * min(1.0, 4.0 / max(longest, 1e-12))
        if longest < 1e-3:
            break
    return best


def _histogram(weight: np.ndarray):
    def run(batches):
        total = np.zeros((2, BINS), np.int64)
        for batch in batches:
            if batch.num_rows:
                p = 1 / (1 + np.exp(-np.clip(_design(batch) @ weight, -500, 500)))
                cell = np.minimum((p * BINS).astype(np.int64), BINS - 1)
                total[0] += np.bincount(cell, minlength=BINS)
                total[1] += np.bincount(cell[_positive(batch)], minlength=BINS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BINS, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], ["cell", "n", "p"]
        )

    return run


def estimate_prior(rows: DataFrame, weight: np.ndarray) -> float:
    """Least ratio of the tails of all documents and of the positives, with one standard error."""
    table = (
        rows.mapInArrow(_histogram(weight), "cell int, n bigint, p bigint")
        .groupBy("cell")
        .agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
        .toArrow()
        .sort_by("cell")
    )
    everyone, positive = (np.cumsum(table[c].to_numpy()[::-1]) for c in ("n", "p"))
    share = positive / max(1, positive[-1])
    use = share >= LEAST_TAIL
    ratio = (everyone[use] / max(1, everyone[-1])) / share[use] * (1 + 1 / np.sqrt(positive[use]))
    return float(min(0.99, max(0.01, ratio.min())))


def _score(weight: np.ndarray, known: bool):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p = 1 / (1 + np.exp(-np.clip(_design(batch) @ weight, -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(p if known else np.zeros(len(p)))], ["doc_id", "score"]
                )

    return run


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document."""
    trusted = labels.where((F.col("quality") == 1) & ~held_out()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(True).alias("positive")
    )
    rows = described(docs).join(trusted.distinct(), "doc_id", "left")
    rows = cut_lineage(rows.withColumn("positive", F.coalesce("positive", F.lit(False))))
    known = bool(rows.where("positive").limit(1).count())
    weight = np.zeros(FEATURES + 1)
    if known:
        prior = estimate_prior(rows, minimise(rows, 0.5, contrast=True))
        weight = minimise(rows, prior)
    scored = rows.mapInArrow(_score(weight, known), "doc_id bigint, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted")
    )


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(read(spark, folder, "documents"), read(spark, folder, "labels"))
