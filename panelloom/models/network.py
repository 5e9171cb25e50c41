"""Rectifier networks with a weight penalty, for a fleet of networks.

Softmax over one or more hidden layers of rectifiers, on filled and scaled
inputs. A step draws a seeded share of the rows, the same in every re-run, sums
the gradients of all networks over it in one pass and moves each network by Adam
(Kingma and Ba, 2015). The penalty is alpha |W|^2 / (2 n) of the rows drawn;
offsets are not penalised. A network stops when the mean loss of its last WINDOW
steps is not lower than that of the WINDOW before by ``tol``.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

from panelloom.models import fleet
from panelloom.models.fleet import NOBODY, Block, Blocks
from panelloom.models.linear import Scaling
from panelloom.spec import SEED

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 25


@dataclass(frozen=True)
class Network:
    """Hidden layers, penalty and the group that is left out."""

    hidden: tuple[int, ...]
    alpha: float
    out: int = NOBODY


def shapes(inputs: int, hidden: Sequence[int], classes: int) -> list[tuple[int, int]]:
    sizes = [inputs, *hidden, classes]
    return list(zip(sizes, sizes[1:]))


def first_weights(inputs: int, hidden: Sequence[int], classes: int, seed: int) -> np.ndarray:
    """Uniform by fan-in and fan-out; flat, each layer's matrix before its offsets."""
    random = np.random.default_rng(seed)
    parts = []
    for a, b in shapes(inputs, hidden, classes):
        bound = np.sqrt(6 / (a + b))
        parts += [random.uniform(-bound, bound, a * b), random.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def layers(flat: np.ndarray, inputs: int, hidden: Sequence[int], classes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in shapes(inputs, hidden, classes):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def matrices(inputs: int, hidden: Sequence[int], classes: int) -> np.ndarray:
    """1 for a weight, 0 for an offset."""
    return np.concatenate([part for a, b in shapes(inputs, hidden, classes) for part in (np.ones(a * b), np.zeros(b))])


def forward(parts: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> list[np.ndarray]:
    """Inputs of every layer, the chances last."""
    seen = [x]
    for w, b in parts[:-1]:
        seen.append(np.maximum(seen[-1] @ w + b, 0.0))
    scores = seen[-1] @ parts[-1][0] + parts[-1][1]
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return [*seen, e / e.sum(axis=1, keepdims=True)]


def loss_and_gradient(
    flat: np.ndarray, hidden: Sequence[int], classes: int, x: np.ndarray, y: np.ndarray, n: np.ndarray | float = 1.0
) -> tuple[float, np.ndarray]:
    """Sums over the rows, ``n`` of each, without the penalty."""
    parts = layers(flat, x.shape[1], hidden, classes)
    *seen, p = forward(parts, x)
    n = np.broadcast_to(n, len(y)).astype(float)
    loss = -float(n @ np.log(np.clip(p[np.arange(len(y)), y], 1e-300, None)))
    back, out = (p - (y[:, None] == np.arange(classes))) * n[:, None], []
    for i in range(len(parts) - 1, -1, -1):
        out = [(seen[i].T @ back).ravel(), back.sum(axis=0), *out]
        if i:
            back = (back @ parts[i][0].T) * (seen[i] > 0)
    return loss, np.concatenate(out)


def drawn(block: Block, step: int, share: float, seed: int) -> np.ndarray:
    """How many of the rows alike a step draws; depends on the block's numbers, not on where it is."""
    random = np.random.default_rng([seed, step, zlib.crc32(block["x"].tobytes()), zlib.crc32(block["g"].tobytes())])
    return random.binomial(block["n"], share)


def train(
    blocks: Blocks, scaled: Scaling, networks: Sequence[Network], most: int = 3000, share: float = 0.5, rate: float = 0.01,
    tol: float = 1e-4, seed: int = SEED,
) -> list[np.ndarray]:
    """Flat weights of every network."""
    width, classes = len(scaled.layout.features), scaled.layout.classes
    flat = [first_weights(width, n.hidden, classes, seed) for n in networks]
    weighed = [matrices(width, n.hidden, classes) for n in networks]
    mean, square = [np.zeros_like(f) for f in flat], [np.zeros_like(f) for f in flat]
    losses: list[list[float]] = [[] for _ in networks]
    active = set(range(len(networks)))
    for step in range(1, most + 1):
        now = {m: flat[m] for m in sorted(active)}

        def partial(block: Block, now=now, step=step) -> Iterator[tuple[int, np.ndarray]]:
            some, inputs = drawn(block, step, share, seed), {}
            for m, weights in now.items():
                out = networks[m].out
                if out not in inputs:
                    used = (some > 0) & (block["g"] != out)
                    inputs[out] = scaled.scaled(block["x"][used], out), block["y"][used], some[used]
                x, y, n = inputs[out]
                if len(y):
                    loss, gradient = loss_and_gradient(weights, networks[m].hidden, classes, x, y, n)
                    yield m, np.concatenate([[n.sum(), loss], gradient])

        found = fleet.reduce(blocks, width, partial, numbers=sum(len(f) + 2 for f in now.values()))
        for m in sorted(active):
            if m not in found:  # nothing drawn for it
                losses[m].append(losses[m][-1] if losses[m] else 0.0)
            else:
                n, loss, gradient = found[m][0], found[m][1], found[m][2:]
                pull = networks[m].alpha * weighed[m] * flat[m]
                gradient = (gradient + pull) / n
                losses[m].append((loss + 0.5 * float(np.sum(pull * flat[m]))) / n)
                mean[m] = 0.9 * mean[m] + 0.1 * gradient
                square[m] = 0.999 * square[m] + 0.001 * gradient**2
                flat[m] = flat[m] - rate * (mean[m] / (1 - 0.9**step)) / (np.sqrt(square[m] / (1 - 0.999**step)) + 1e-8)
            past = losses[m]
            if len(past) >= 2 * WINDOW and np.mean(past[-WINDOW:]) > np.mean(past[-2 * WINDOW : -WINDOW]) - tol:
                active.discard(m)
        if not active:
            break
    return flat


def predictor(scaled: Scaling, network: Network, flat: np.ndarray):
    """Codes of raw rows."""
    parts = layers(flat, len(scaled.layout.features), network.hidden, scaled.layout.classes)
    return lambda x: forward(parts, scaled.scaled(x, network.out))[-1].argmax(axis=1)
