"""Gradient boosting of several classes at once, for a fleet of boosters.

Multinomial deviance (Friedman, "Greedy function approximation", 2001): every
round fits one regression tree per class to the residuals y - p; a leaf takes
(K - 1) / K * sum(r) / sum(|r| (1 - |r|)). Trees split on at most BINS values a
feature, which are the same for all boosters and look at no label. Rows are kept as codes of their values, equal ones
once with their number. Leaf values come from the sums of the last split.

Up to LIMIT such rows are handed to one task per booster, which trains it to the end.
More stay where they are: a level of all trees of all boosters costs one pass of
histograms. Scores are kept with the rows and brought up to date, by
a checkpoint, every KEEP rounds; the rounds since then are applied on the way.

A booster of many rounds holds those of fewer rounds, so the scores after each
number in ``stages`` belong to a candidate of their own.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions import ordering
from panelloom.models import fleet
from panelloom.models.fleet import NOBODY, Block, Blocks, Layout, count_confusion, joined

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
MISSING = 255
KEEP = 10
LIMIT = 1 << 20  # rows of different codes that a task trains a booster on alone


@dataclass(frozen=True)
class Booster:
    """Settings of one booster and the group it does not learn from."""

    depth: int
    rate: float
    out: int = NOBODY


@dataclass
class Tree:
    """A full tree in heap order; a node that is not split sends all rows left."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        return cls(np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, int), np.zeros(1 << depth))

    def places(self, codes: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row within its level, after so many levels; codes are by feature, then row."""
        at = np.zeros(codes.shape[1], np.uint8)
        for level in range(levels):
            right = np.zeros(codes.shape[1], bool)
            # Whole columns are compared, which costs less than to look up each row's own feature.
            for place in range(1 << level):
                node = (1 << level) - 1 + place
                if self.feature[node] >= 0:
                    right |= (at == place) & (codes[self.feature[node]] > self.cut[node])
            at = 2 * at + right
        return at

    @property
    def depth(self) -> int:
        return len(self.leaf).bit_length() - 1

    def values(self, codes: np.ndarray) -> np.ndarray:
        return self.leaf[self.places(codes, self.depth)]


@dataclass
class Ensemble:
    """Trees by round, booster and class, with what is needed to apply them."""

    layout: Layout
    edges: list[np.ndarray]
    boosters: list[Booster]
    start: np.ndarray  # booster, class
    rounds: list[list[list[Tree]]] = field(default_factory=list)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A byte per row and feature, MISSING for a gap."""
        return codes_of(self.edges, x)

    def filled_codes(self, codes: np.ndarray, out: int) -> np.ndarray:
        return np.where(codes == MISSING, self.codes(self.layout.medians[out][None, :]).T, codes)

    def scores(self, x: np.ndarray, booster: int, rounds: int) -> np.ndarray:
        """Scores by class after so many rounds."""
        codes = self.filled_codes(np.ascontiguousarray(self.codes(x).T), self.boosters[booster].out)
        total = np.tile(self.start[booster], (len(x), 1))
        for trees in self.rounds[:rounds]:
            for k, tree in enumerate(trees[booster]):
                total[:, k] += self.boosters[booster].rate * tree.values(codes)
        return total

    def since(self, number: int) -> "Ensemble":
        """What a pass over rows whose scores hold the first rounds needs: the trees of the later ones."""
        return Ensemble(self.layout, self.edges, self.boosters, self.start, self.rounds[number:])

    def only(self, booster: int, rounds: int) -> "Ensemble":
        chosen = [[trees[booster]] for trees in self.rounds[:rounds]]
        return Ensemble(self.layout, self.edges, [self.boosters[booster]], self.start[booster : booster + 1], chosen)


def split_values(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Where trees may split each feature: a value goes left of a cut at or above it.

    A feature of few values has a cut between every two; others are cut at
    their quantiles. The counts come from a table of at most ``bins`` rows a feature.
    """
    few = {f: [] for f in features}
    kinds = ordering.melt(rows, features).groupBy("feature", "value").agg(F.count("*").alias("n"))
    numbered = kinds.groupBy("feature").agg(F.count("*").alias("kinds"))
    rare = [r.feature for r in numbered.where(F.col("kinds") <= bins).collect()]
    if rare:
        for r in kinds.where(F.col("feature").isin(rare)).collect():
            few[r.feature].append(r.value)
    many = [f for f in features if f not in rare]
    cuts = {f: np.array([(a + b) / 2 for a, b in zip(sorted(v), sorted(v)[1:])]) for f, v in few.items()}
    if many:
        shares = [i / bins for i in range(1, bins)]
        found: dict[str, list[float]] = {f: [] for f in many}
        for r in ordering.quantiles(rows, many, shares).collect():
            if r["quantile"] is not None:
                found[r["feature"]].append(r["quantile"])
        cuts |= {f: np.unique(v) for f, v in found.items()}
    return [cuts[f] for f in features]


def codes_of(edges: Sequence[np.ndarray], x: np.ndarray) -> np.ndarray:
    found = np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)])
    return np.where(np.isnan(x), MISSING, found).astype(np.uint8)


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class _State:
    """A block with codes by left-out group and scores of all boosters up to date; the trees are those the scores lack."""

    def __init__(self, block: Block, ensemble: Ensemble) -> None:
        self.y, self.g, self.n = block["y"], block["g"], block["n"].astype(float)
        self.coded: dict[int, np.ndarray] = {}
        shape = (len(self.y), *ensemble.start.shape)
        kept = block["state"]
        self.scores = (kept.reshape(shape) if len(kept) else np.broadcast_to(ensemble.start, shape)).astype(np.float64)
        self.inputs: dict[int, tuple[np.ndarray, ...]] = {}
        for m, booster in enumerate(ensemble.boosters):
            if booster.out not in self.coded:
                self.coded[booster.out] = ensemble.filled_codes(block["codes"], booster.out)
            for trees in ensemble.rounds:
                self.add(m, booster, trees[m])

    def add(self, m: int, booster: Booster, trees: list[Tree]) -> None:
        for k, tree in enumerate(trees):
            self.scores[:, m, k] += booster.rate * tree.values(self.coded[booster.out])

    def learnt_from(self, out: int) -> tuple[np.ndarray, ...]:
        """Which rows count, their codes, labels and numbers."""
        if out not in self.inputs:
            used = self.g != out
            self.inputs[out] = used, self.coded[out][:, used], self.y[used], self.n[used]
        return self.inputs[out]

    def confusion(self, m: int, booster: Booster, n: np.ndarray) -> np.ndarray | None:
        """Of the rows of the group left out, if there are any."""
        rows = self.g == booster.out
        if not rows.any():
            return None
        return count_confusion(self.y[rows], self.scores[rows, m].argmax(axis=1), self.scores.shape[2], n[rows])


def _sums(state: _State, ensemble: Ensemble, trees: list[list[Tree]], level: int) -> Iterator[tuple[int, np.ndarray]]:
    """Counts, residuals and curvatures by booster and class, node, feature and code."""
    width, classes = len(ensemble.edges), ensemble.start.shape[1]
    for m, booster in enumerate(ensemble.boosters):
        if level >= booster.depth:
            continue
        used, codes, y, n = state.learnt_from(booster.out)
        if not codes.shape[1]:
            continue
        chance = _softmax(state.scores[used, m])
        for k in range(classes):
            r = (y == k) - chance[:, k]
            h = np.abs(r) * (1 - np.abs(r))
            weights = n, n * r, n * h
            begin = trees[m][k].places(codes, level).astype(np.intp) * BINS
            sums = np.empty((3, 1 << level, width, BINS))
            for j in range(width):
                place = begin + codes[j]
                for i, v in enumerate(weights):
                    sums[i, :, j] = np.bincount(place, v, minlength=BINS << level).reshape(-1, BINS)
            yield m * classes + k, sums


def _histograms(ensemble: Ensemble, trees: list[list[Tree]], level: int):
    return lambda block: _sums(_State(block, ensemble), ensemble, trees, level)


def _best_splits(width: int, level: int):
    """Per node: feature, cut, then sums of rows, residuals and curvatures left and right.

    The gain is that of least squares, n_l n_r / n (mean_l - mean_r)^2; of equal
    gains the first feature and the lowest cut win.
    """

    def finish(_: int, flat: np.ndarray) -> list[float]:
        sums = flat.reshape(3, 1 << level, width, BINS)
        out = []
        for node in range(1 << level):
            left = np.cumsum(sums[:, node], axis=2)[:, :, :-1]
            whole = sums[:, node, 0].sum(axis=1)
            right = whole[:, None, None] - left
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left[0] * right[0] / whole[0] * (left[1] / left[0] - right[1] / right[0]) ** 2
            # Sums in another order differ in the last digits; what differs by less is equal.
            gain = np.where((left[0] > 0) & (right[0] > 0), np.round(gain, 9), 0.0)
            best = int(gain.argmax())
            feature, cut = divmod(best, BINS - 1)
            if gain.ravel()[best] <= 0:
                out += [-1, 0, *whole, 0, 0, 0]
            else:
                out += [feature, cut, *left[:, feature, cut], *right[:, feature, cut]]
        return out

    return finish


def _leaf(classes: int, r: float, h: float) -> float:
    return (classes - 1) / classes * r / h if abs(h) > 1e-150 else 0.0


def _grow(trees: list[list[Tree]], found: dict[int, np.ndarray], level: int, classes: int) -> None:
    """Put the splits of a level into the trees; the leaves below them take the sides' values for now."""
    for key, values in found.items():
        tree = trees[key // classes][key % classes]
        for node, (feature, cut, _, rl, hl, _, rr, hr) in enumerate(values.reshape(-1, 8)):
            at = (1 << level) - 1 + node
            tree.feature[at], tree.cut[at] = int(feature), int(cut)
            span = len(tree.leaf) >> level
            begin = node * span
            if feature < 0:
                # Empty nodes lie under a node that was not split and keep its value.
                if hl > 0 or rl != 0:
                    tree.leaf[begin : begin + span] = _leaf(classes, rl, hl)
            else:
                tree.leaf[begin : begin + span // 2] = _leaf(classes, rl, hl)
                tree.leaf[begin + span // 2 : begin + span] = _leaf(classes, rr, hr)


def start_scores(counts: dict[int, np.ndarray], boosters: Sequence[Booster]) -> np.ndarray:
    """Logarithms of the class shares among the rows each booster learns from."""
    rows = []
    for b in boosters:
        left = counts[NOBODY] - (counts.get(b.out, 0) if b.out != NOBODY else 0)
        shares = left / max(left.sum(), 1)
        rows.append(np.log(np.clip(shares, np.finfo(np.float32).eps, 1 - np.finfo(np.float32).eps)))
    return np.array(rows)


def train(blocks: Blocks, layout: Layout, edges: list[np.ndarray], boosters: Sequence[Booster], rounds: int, stages: Sequence[int] = ()):
    """(ensemble, confusions): all trees, and per stage and booster the confusion counts of the group left out."""
    width = len(layout.features)
    counts = fleet.class_counts(blocks, width, layout.classes)
    ensemble = Ensemble(layout, edges, list(boosters), start_scores(counts, boosters))
    blocks = fleet.coded(blocks, width, lambda x: codes_of(edges, x), max(1, 4 // len(boosters)))
    if blocks.rows <= LIMIT:
        return _trained_apart(blocks, ensemble, rounds, stages)
    since, confusions = 0, {}

    def pass_over(trees: list[list[Tree]], level: int) -> dict[int, np.ndarray]:
        numbers = sum(b.depth > level for b in boosters) * layout.classes * 3 * (width * BINS << level)
        return fleet.reduce(blocks, width, _histograms(ensemble.since(since), trees, level), _best_splits(width, level), numbers)

    for number in range(1, rounds + 1):
        ensemble.rounds.append(_round(ensemble, pass_over))
        if number in stages:
            confusions[number] = _confusions(blocks, width, ensemble.since(since))
        if number % KEEP == 0 and number < rounds:
            blocks = fleet.each_block(blocks, width, _brought_up(ensemble.since(since)))
            since = number
    return ensemble, confusions


def _round(ensemble: Ensemble, splits: Callable[[list[list[Tree]], int], dict[int, np.ndarray]]) -> list[list[Tree]]:
    """The next tree per booster and class, from the ``splits`` of each level."""
    classes = ensemble.start.shape[1]
    trees = [[Tree.empty(b.depth) for _ in range(classes)] for b in ensemble.boosters]
    for level in range(max(b.depth for b in ensemble.boosters)):
        _grow(trees, splits(trees, level), level, classes)
    return trees


def _trained_apart(blocks: Blocks, ensemble: Ensemble, rounds: int, stages: Sequence[int]):
    """The same, every booster by a task that gets all rows."""
    width, classes = len(ensemble.edges), ensemble.start.shape[1]
    kinds = {"feature": np.int64, "cut": np.int64, "leaf": np.float64}

    def one(table: pa.Table) -> pa.Table:
        m = table.column("m")[0].as_py()
        booster = ensemble.boosters[m]
        own = Ensemble(ensemble.layout, ensemble.edges, [booster], ensemble.start[m : m + 1])
        block = joined(table.drop_columns("m"), width)
        state, found = _State(block, own), []

        def here(trees: list[list[Tree]], level: int) -> dict[int, np.ndarray]:
            finish = _best_splits(width, level)
            return {key: np.array(finish(key, sums.ravel())) for key, sums in _sums(state, own, trees, level)}

        for number in range(1, rounds + 1):
            trees = _round(own, here)
            state.add(0, booster, trees[0])
            own.rounds.append(trees)
            if number in stages:
                confusion = state.confusion(0, booster, block["n"])
                found += [] if confusion is None else [confusion]
        # By round, class and node.
        parts = {name: np.array([[getattr(t, name) for t in trees[0]] for trees in own.rounds], kind) for name, kind in kinds.items()}
        parts["confusions"] = np.array(found, float)
        return pa.table({"m": pa.array([m], pa.int32())} | {name: [values.tobytes()] for name, values in parts.items()})

    whose = F.explode(F.sequence(F.lit(0), F.lit(len(ensemble.boosters) - 1))).alias("m")
    # Four times the tasks, so that hashing seldom puts two boosters into one.
    dealt = blocks.frame.select(whose, "*").repartition(4 * len(ensemble.boosters), "m")
    schema = "m int, feature binary, cut binary, leaf binary, confusions binary"
    trained, confusions = {}, {number: {} for number in stages}
    for r in dealt.groupBy("m").applyInArrow(one, schema).collect():
        parts = [np.frombuffer(r[name], kind).reshape(rounds, classes, -1) for name, kind in kinds.items()]
        trained[r.m] = [[Tree(*[p[i, k] for p in parts]) for k in range(classes)] for i in range(rounds)]
        for number, found in zip(sorted(stages), np.frombuffer(r.confusions).reshape(-1, classes, classes)):
            confusions[number][r.m] = found
    ensemble.rounds = [list(trees) for trees in zip(*[trained[m] for m in sorted(trained)])]
    return ensemble, confusions


def _brought_up(ensemble: Ensemble):
    def change(block: Block) -> Block:
        return block | {"state": _State(block, ensemble).scores.astype(np.float32)}

    return change


def _confusions(blocks: Blocks, width: int, ensemble: Ensemble) -> dict[int, np.ndarray]:
    classes = ensemble.start.shape[1]

    def partial(block: Block) -> Iterator[tuple[int, np.ndarray]]:
        state = _State(block, ensemble)
        for m, booster in enumerate(ensemble.boosters):
            confusion = state.confusion(m, booster, block["n"])
            if confusion is not None:
                yield m, confusion

    return {m: v.reshape(classes, classes) for m, v in fleet.reduce(blocks, width, partial).items()}
