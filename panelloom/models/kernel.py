"""Support vector machines of a fleet: one machine per pair of labels, and votes.

Each machine minimises |w|^2 / 2 + sum C_i hinge(row) over the rows of its two
labels outside the group left out; the offset is not penalised. A Gaussian
kernel enters by Nyström landmarks (Williams and Seeger, 2001): ``width`` rows
that the model may see, and the factor of the kernel among them, so that
products of mapped rows are the kernel up to what the landmarks do not span;
``kernel_error`` measures that. With as many landmarks as rows it is exact.

The hinge is rounded off around its corner (Chapelle, 2007) and the rounding
made narrower in stages, so Newton steps apply. A pass sums loss, gradient and
curvature of every machine that has not converged; a machine moves
(width + 1)^2 / 2 numbers a task, which bounds the landmarks, not the rows.
"""

from __future__ import annotations

import sys
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.models import fleet
from panelloom.models.fleet import NOBODY, Block, Blocks
from panelloom.models.linear import Scaling, balanced
from panelloom.spec import SEED

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 128
ROUNDINGS = (1.0, 0.3, 0.1, 0.03)  # half widths of the rounded corner
TOLERANCE = 1e-5  # of the gradient, by the sum of all costs


def gaussian(x: np.ndarray, points: np.ndarray, gamma: float) -> np.ndarray:
    apart = (x**2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2 * x @ points.T
    return np.exp(-gamma * np.maximum(apart, 0.0))


@dataclass(frozen=True)
class Landmarks:
    """Scaled rows that stand for a Gaussian kernel and the factor of the kernel among them."""

    points: np.ndarray
    gamma: float
    factor: np.ndarray

    def mapped(self, x: np.ndarray) -> np.ndarray:
        return gaussian(x, self.points, self.gamma) @ self.factor


def factored(points: np.ndarray, gamma: float) -> Landmarks:
    """Directions that repeated or close landmarks leave empty are dropped."""
    values, vectors = np.linalg.eigh(gaussian(points, points, gamma))
    kept = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
    return Landmarks(points, gamma, vectors[:, kept] / np.sqrt(values[kept]))


def kernel_error(landmarks: Landmarks, x: np.ndarray) -> float:
    """Mean absolute error of the products of mapped rows, over all pairs of a few given rows."""
    mapped = landmarks.mapped(x)
    return float(np.abs(mapped @ mapped.T - gaussian(x, x, landmarks.gamma)).mean())


def landmarks(
    rows: DataFrame, group: str, blocks: Blocks, scaled: Scaling, outs: Sequence[int], width: int = WIDTH, seed: int = SEED
) -> dict[int, Landmarks]:
    """By left-out group, the first ``width`` rows of the others in seeded hash order.

    The limit is applied before rows are shuffled; the driver sees ``width`` rows a group.
    Gamma is one over the inputs and their variance.
    """
    features, outs = list(scaled.layout.features), sorted(set(outs))
    names = [f"x{i}" for i in range(len(features))]
    numbers = rows.select(*[F.col(f).cast("double").alias(n) for f, n in zip(features, names)], F.col(group).alias("own"))
    lists = F.array(*[F.lit(o) for o in outs])
    filled = [F.coalesce(n, F.lit(float("nan"))) for n in names]
    copies = numbers.select(*names, F.xxhash64(F.lit(seed), *filled).alias("place"), F.explode(F.filter(lists, lambda o: o != F.col("own"))).alias("out"))
    first = copies.withColumn("n", F.row_number().over(Window.partitionBy("out").orderBy("place", *names))).where(F.col("n") <= width)
    chosen: dict[int, list] = {o: [] for o in outs}
    for r in first.orderBy("out", "n").collect():
        chosen[r["out"]].append([np.nan if r[n] is None else r[n] for n in names])

    def squares(block: Block) -> Iterator[tuple[int, np.ndarray]]:
        for i, out in enumerate(outs):
            used = block["g"] != out
            n = block["n"][used].astype(float)
            yield i, np.array([(n @ scaled.scaled(block["x"][used], out) ** 2).sum(), n.sum()])

    spread = {outs[i]: v[0] / max(v[1], 1.0) for i, v in fleet.reduce(blocks, len(features), squares).items()}
    return {
        o: factored(scaled.scaled(np.array(chosen[o]).reshape(-1, len(features)), o), 1.0 / spread[o] if spread.get(o) else 1.0) for o in outs
    }


@dataclass(frozen=True)
class Machine:
    """Cost and labels of a machine, its kernel (no landmarks: linear) and the group left out."""

    cost: float
    width: int
    out: int
    first: int
    second: int


def inputs_of(x: np.ndarray, machine: Machine, scaled: Scaling, maps: dict[tuple[int, int], Landmarks]) -> np.ndarray:
    """Rows as a machine sees them, a one last for the offset."""
    x = scaled.scaled(x, machine.out)
    if machine.width:
        x = maps[machine.width, machine.out].mapped(x)
    return np.column_stack([x, np.ones(len(x))])


def sums(point: np.ndarray, x: np.ndarray, side: np.ndarray, cost: np.ndarray, h: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature of the rounded hinge over some rows, without the penalty."""
    short = 1.0 - side * (x @ point)
    bend = np.abs(short) <= h
    loss = np.where(bend, (short + h) ** 2 / (4 * h), np.maximum(short, 0.0))
    slope = np.where(bend, (short + h) / (2 * h), short > 0) * cost * -side
    bent = x[bend]
    return float(cost @ loss), x.T @ slope, (bent * (cost[bend] / (2 * h))[:, None]).T @ bent


def train(
    blocks: Blocks, scaled: Scaling, maps: dict[tuple[int, int], Landmarks], machines: Sequence[Machine], most: int = 200
) -> list[np.ndarray]:
    """Weights of every machine, its offset last."""
    layout = scaled.layout
    counts = fleet.class_counts(blocks, len(layout.features), layout.classes)
    left = {m.out: counts[NOBODY] - (counts.get(m.out, 0) if m.out != NOBODY else 0) for m in machines}
    price = {out: balanced(counts, out) for out in left}
    size = [1 + (maps[m.width, m.out].factor.shape[1] if m.width else len(layout.features)) for m in machines]
    total = [m.cost * sum(price[m.out][k] * left[m.out][k] for k in (m.first, m.second)) for m in machines]
    weights = [np.zeros(s) for s in size]
    trial, step = [w.copy() for w in weights], [None] * len(machines)
    best, stage = [np.inf] * len(machines), [0] * len(machines)
    waiting = {i for i, t in enumerate(total) if t > 0}  # without rows no machine
    # Machines that see rows alike follow each other, so that a block is mapped once for them.
    order = sorted(range(len(machines)), key=lambda i: (machines[i].out, machines[i].width))

    def partial_of(points: dict[int, tuple[np.ndarray, float]]):
        def partial(block: Block) -> Iterator[tuple[int, np.ndarray]]:
            seen = None
            for i, (point, h) in points.items():
                m = machines[i]
                if seen != (m.out, m.width):
                    seen, used = (m.out, m.width), block["g"] != m.out
                    inputs, labels, n = inputs_of(block["x"][used], m, scaled, maps), block["y"][used], block["n"][used]
                own = (labels == m.first) | (labels == m.second)
                if own.any():
                    side = np.where(labels[own] == m.first, 1.0, -1.0)
                    loss, slope, curve = sums(point, inputs[own], side, m.cost * price[m.out][labels[own]] * n[own], h)
                    yield i, np.concatenate([[loss], slope, curve[np.triu_indices(len(point))]])

        return partial

    for _ in range(most):
        if not waiting:
            break
        found = fleet.reduce(blocks, len(layout.features), partial_of({i: (trial[i], ROUNDINGS[stage[i]]) for i in order if i in waiting}))
        for i in sorted(waiting):
            n = size[i]
            loss, gradient, curve = found[i][0], found[i][1 : n + 1].copy(), np.zeros((n, n))
            curve[np.triu_indices(n)] = found[i][n + 1 :]
            curve = np.triu(curve) + np.triu(curve, 1).T
            loss += 0.5 * float(trial[i][:-1] @ trial[i][:-1])
            gradient[:-1] += trial[i][:-1]
            if loss > best[i] * (1 + 1e-12) and np.abs(step[i]).max() > 1e-10:  # too far: half the way back
                step[i] = step[i] / 2
                trial[i] = weights[i] + step[i]
                continue
            stuck = loss > best[i]
            if not stuck:
                best[i], weights[i] = loss, trial[i]
            if stuck or np.abs(gradient).max() < TOLERANCE * total[i]:
                stage[i], best[i], trial[i] = stage[i] + 1, np.inf, weights[i]
                if stage[i] == len(ROUNDINGS):
                    waiting.discard(i)
                continue
            # Where no row lies in the bend the offset has no curvature of its own.
            step[i] = -np.linalg.solve(curve + np.diag(np.append(np.ones(n - 1), 0.01 * total[i])), gradient)
            trial[i] = weights[i] + step[i]
    if waiting:
        warnings.warn(f"{len(waiting)} of {len(machines)} machines did not converge in {most} passes", stacklevel=2)
    return weights


def pairs(classes: int) -> list[tuple[int, int]]:
    return list(combinations(range(classes), 2))


def predictor(scaled: Scaling, maps: dict[tuple[int, int], Landmarks], machines: Sequence[Machine], weights: Sequence[np.ndarray]):
    """Codes of raw rows: the label with most votes of the machines of one setting, the first on a tie."""
    own = {k: v for k, v in maps.items() if k == (machines[0].width, machines[0].out)}
    classes = scaled.layout.classes

    def codes(x: np.ndarray) -> np.ndarray:
        inputs = inputs_of(x, machines[0], scaled, own)
        votes = np.zeros((len(x), classes), int)
        for m, w in zip(machines, weights):
            if w.any():
                said = np.where(inputs @ w > 0, m.first, m.second)
                votes[np.arange(len(x)), said] += 1
        return votes.argmax(axis=1)

    return codes
