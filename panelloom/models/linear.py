"""Multinomial logistic regressions of a fleet, by damped Newton steps.

Each model minimises the weighted mean of its losses plus |W|^2 / (2 C n) over
the rows of all groups but one, on filled and scaled inputs; intercepts are not
penalised. A step sums loss, gradient and curvature of every model that has not
converged in one pass. Models of all rows come first, the first from zero, those
of other penalties from it; a model that leaves out a group starts from that of
all rows, which it is close to, and so takes few steps. The curvature has (classes * (features + 1))^2 numbers a
model, which bounds the number of features, not of rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

from panelloom.models import fleet
from panelloom.models.fleet import NOBODY, Block, Blocks, Layout, count_confusion

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOLERANCE = 1e-7


@dataclass(frozen=True)
class Scaling:
    """Filled inputs are centred and divided by these, by left-out group; constants are only centred."""

    layout: Layout
    mean: dict[int, np.ndarray]
    std: dict[int, np.ndarray]

    def scaled(self, x: np.ndarray, out: int) -> np.ndarray:
        return (self.layout.filled(x, out) - self.mean[out]) / self.std[out]


def scaling(blocks: Blocks, layout: Layout, outs: Sequence[int]) -> Scaling:
    """Two passes: means, then squared distances from them."""
    width = len(layout.features)
    outs = sorted(set(outs))

    def sums(block: Block) -> Iterator[tuple[int, np.ndarray]]:
        for i, out in enumerate(outs):
            used = block["g"] != out
            n = block["n"][used].astype(float)
            yield i, np.append(n @ layout.filled(block["x"][used], out), n.sum())

    found = {outs[i]: v for i, v in fleet.reduce(blocks, width, sums).items()}
    mean = {o: found[o][:-1] / max(found[o][-1], 1) for o in outs}

    def squares(block: Block) -> Iterator[tuple[int, np.ndarray]]:
        for i, out in enumerate(outs):
            used = block["g"] != out
            yield i, block["n"][used].astype(float) @ (layout.filled(block["x"][used], out) - mean[out]) ** 2

    spread = {outs[i]: v for i, v in fleet.reduce(blocks, width, squares).items()}
    std = {o: np.sqrt(spread[o] / max(found[o][-1], 1)) for o in outs}
    # What is left of a constant after rounding is no deviation.
    std = {o: np.where(s > 1e-12 * (1 + np.abs(mean[o])), s, 1.0) for o, s in std.items()}
    return Scaling(layout, mean, std)


def balanced(counts: dict[int, np.ndarray], out: int) -> np.ndarray:
    """Weight n / (k n_c) of each class among the rows of all groups but ``out``."""
    left = counts[NOBODY] - (counts.get(out, 0) if out != NOBODY else 0)
    present = (left > 0).sum()
    return np.where(left > 0, left.sum() / np.maximum(present * left, 1), 0.0)


def chances(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    scores = x @ weights[:, :-1].T + weights[:, -1]
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(blocks: Blocks, scaled: Scaling, settings: Sequence[tuple[float, int]], most: int = 100) -> list[np.ndarray]:
    """Weights (class, feature + 1) of a model per (C, left-out group)."""
    layout = scaled.layout
    width, classes = len(layout.features), layout.classes
    counts = fleet.class_counts(blocks, width, classes)
    outs = {NOBODY, *(out for _, out in settings)}
    price = {out: balanced(counts, out) for out in outs}
    rows = {out: float((counts[NOBODY] - (counts.get(out, 0) if out != NOBODY else 0)).sum()) for out in outs}
    size = classes * (width + 1)
    penalised = np.tile(np.append(np.ones(width), 0.0), classes)
    def partial_of(points: dict[int, np.ndarray], left_out: dict[int, int]):
        def partial(block: Block) -> Iterator[tuple[int, np.ndarray]]:
            ready = None
            # Models without the same group follow each other: only one group's inputs are held.
            for m, point in sorted(points.items(), key=lambda item: left_out[item[0]]):
                out = left_out[m]
                if out != ready:
                    used = block["g"] != out
                    x, y, n = np.column_stack([scaled.scaled(block["x"][used], out), np.ones(used.sum())]), block["y"][used], block["n"][used]
                    ready = out
                if not len(y):
                    continue
                p, w = chances(point.reshape(classes, -1), x[:, :-1]), price[out][y] * n
                loss = -np.sum(w * np.log(np.clip(p[np.arange(len(y)), y], 1e-300, None)))
                wrong = (p - (y[:, None] == np.arange(classes))) * w[:, None]
                # Chances add up to one, so a class's own part is what its parts with the others leave.
                curve = np.zeros((classes, width + 1, classes, width + 1))
                for a in range(classes):
                    for b in range(a):
                        shared = (x * (w * p[:, a] * p[:, b])[:, None]).T @ x
                        curve[a, :, b] = curve[b, :, a] = -shared
                        curve[a, :, a] += shared
                        curve[b, :, b] += shared
                yield m, np.concatenate([[loss], (wrong.T @ x).ravel(), curve.ravel()])

        return partial

    def descend(chosen: list[tuple[float, int]], start: list[np.ndarray]) -> dict[tuple[float, int], np.ndarray]:
        weights, trial, step = list(start), list(start), [None] * len(chosen)
        best, waiting = [np.inf] * len(chosen), set(range(len(chosen)))
        for _ in range(most):
            if not waiting:
                break
            points = {m: trial[m] for m in sorted(waiting)}
            found = fleet.reduce(blocks, width, partial_of(points, {m: chosen[m][1] for m in points}))
            for m in sorted(waiting):
                c, out = chosen[m]
                n = max(rows[out], 1.0)
                loss, gradient, curve = found[m][0] / n, found[m][1 : size + 1] / n, found[m][size + 1 :].reshape(size, size) / n
                ridge = penalised / (c * n)
                loss += 0.5 * np.sum(ridge * trial[m] ** 2)
                gradient = gradient + ridge * trial[m]
                if loss > best[m] + 1e-12:  # too far: half the way back
                    step[m] = step[m] / 2
                    trial[m] = weights[m] + step[m]
                    if np.abs(step[m]).max() < 1e-12:
                        waiting.discard(m)
                    continue
                best[m], weights[m] = loss, trial[m]
                if np.abs(gradient).max() < TOLERANCE:
                    waiting.discard(m)
                    continue
                # Equal shifts of all classes change nothing; the least step is taken.
                step[m] = -np.linalg.lstsq(curve + np.diag(ridge), gradient, rcond=1e-12)[0]
                trial[m] = weights[m] + step[m]
        return dict(zip(chosen, weights))

    leaders = [(c, NOBODY) for c in dict.fromkeys(c for c, _ in settings)]
    trained = descend(leaders[:1], [np.zeros(size)])
    trained |= descend(leaders[1:], [trained[leaders[0]]] * (len(leaders) - 1))
    others = list(dict.fromkeys(s for s in settings if s[1] != NOBODY))
    trained |= descend(others, [trained[c, NOBODY] for c, _ in others])
    return [trained[s].reshape(classes, width + 1) for s in settings]


def confusions(blocks: Blocks, width: int, classes: int, models: Sequence[tuple[int, object]]) -> dict[int, np.ndarray]:
    """Per model (left-out group, codes of rows) its confusion counts on the group left out."""

    def partial(block: Block) -> Iterator[tuple[int, np.ndarray]]:
        for m, (out, predict) in enumerate(models):
            held = block["g"] == out
            if held.any():
                yield m, count_confusion(block["y"][held], predict(block["x"][held]), classes, block["n"][held])

    return {m: v.reshape(classes, classes) for m, v in fleet.reduce(blocks, width, partial).items()}


def predictor(scaled: Scaling, weights: np.ndarray, out: int):
    """Codes of raw rows."""
    return lambda x: chances(weights, scaled.scaled(x, out)).argmax(axis=1)
