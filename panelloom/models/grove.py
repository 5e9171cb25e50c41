"""Forests that each leave one subject out, grown together.

A forest without a subject says something only about that subject's rows, so of each of its
trees only the nodes on their paths are needed. The forests share their draws: how often a row is
drawn for a tree, and which features a node may split on, hang on the row, the tree and the place of the
node. The sums of a node without a subject are those of all its rows less the subject's own, and
subjects that choose the same split go on to the same node. A node is therefore worked out once
for all that meet in it, not once per subject.

Each forest has its own medians and balanced weights, from the rows without its subject. Cut
points are at most BINS - 1 a feature, found without labels on all rows; gaps are counted apart and
go where the subject's median lies.

A node of at most LIMIT rows is finished by one task with all below it. Larger ones, at the top of a
tree, are summed over all tasks level by level.
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
from panelloom.models.boosting import MISSING, codes_of, split_values
from panelloom.session import cut_lineage
from panelloom.spec import SEED

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 31  # odd, so that the middle of a feature lies inside a bin
LIMIT = 1 << 20  # rows of a node that one task finishes
PIECE = 1 << 19  # entries of nodes that a task looks at together
PAIRS = 512  # nodes and subjects whose splits are compared at once; their arrays should stay in the processor's cache
MOST_TASKS = 4096
ONE = 1 << 40  # votes are whole parts of this, so that their sum does not hang on its order

# Chances of being drawn 0, 1, 2, ... times, added up (Poisson, mean 1).
DRAWN = np.cumsum(np.exp(-1.0) / np.cumprod(np.array([1.0, *range(1, 18)])))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Even 64-bit hash of 64-bit numbers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keyed(x: np.ndarray, number: int | np.ndarray) -> np.ndarray:
    return _mixed(x + (np.atleast_1d(number).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Rows:
    """Rows of whole subjects; a subject has its fill codes and the weights of its model."""

    codes: np.ndarray  # feature, row; BINS stands for a gap
    y: np.ndarray
    sub: np.ndarray  # place of the row's subject in what follows
    place: np.ndarray  # of the row within its subject
    number: np.ndarray  # by subject
    seed: np.ndarray
    fill: np.ndarray
    weight: np.ndarray

    def drawn(self, tree: int) -> np.ndarray:
        """How often each row is drawn for a tree."""
        key = _keyed(_keyed(self.seed[self.sub], self.place), tree)
        return np.searchsorted(DRAWN, (key >> np.uint64(11)) * 2.0**-53, side="right")


@dataclass(frozen=True)
class Plan:
    """What all trees have in common."""

    width: int
    classes: int
    trees: int
    depth: int

    def inputs(self, tree: int, heap: np.ndarray) -> np.ndarray:
        """The features that nodes may split on, as many as the root of all, by place in the tree."""
        key = _keyed(_keyed(np.full((len(heap), self.width), SEED, np.uint64), tree), heap[:, None])
        some = _keyed(key, np.arange(self.width)[None, :]).argsort(axis=1)[:, : int(np.ceil(np.sqrt(self.width)))]
        return np.sort(some, axis=1)


@dataclass
class Top:
    """A node above or at those that a task finishes; with sums if it is above."""

    tree: int
    level: int
    heap: int
    size: float
    sums: np.ndarray | None = None
    split: dict[tuple[int, int, int, int], int] = field(default_factory=dict)  # feature, cut, gaps left, side


def _histogram(plan: Plan, rows: Rows, inputs: np.ndarray, node: np.ndarray, at: np.ndarray, n: np.ndarray, key: np.ndarray | None = None, keys: int = 0) -> np.ndarray:
    """Draws by node (or by key), input, code and class."""
    key, keys = (node, len(inputs)) if key is None else (key, keys)
    most = inputs.shape[1]
    # All inputs are counted at once: adding arrays of the size of the result costs more than the counting.
    place = ((key[:, None] * most + np.arange(most)) * (BINS + 1) + rows.codes[inputs[node].T, at].T) * plan.classes + rows.y[at][:, None]
    found = np.bincount(place.ravel(), np.repeat(n, most), minlength=keys * most * (BINS + 1) * plan.classes)
    return found.reshape(keys, most, BINS + 1, plan.classes)


def _best(sums: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input and cut of the largest fall in weighted Gini impurity, the first of equal ones; -1 for none."""
    # Classes come first: numpy adds a few whole arrays faster than many short rows.
    left = np.ascontiguousarray(np.moveaxis(sums, 3, 0)).cumsum(axis=3)
    whole, left = left[:, :, :1, -1:], left[..., :-1]
    scale = weight.T[:, :, None, None]
    n = left.sum(axis=0)
    ok = (n > 0) & (n < whole.sum(axis=0))
    lw, ww = left * scale, whole * scale
    total, below = ww.sum(axis=0), lw.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        kept = np.square(lw).sum(axis=0) / below + np.square(ww - lw).sum(axis=0) / (total - below)
        gain = (kept - np.square(ww).sum(axis=0) / total) / total
    # Sums in another order differ in the last digits; what differs by less is equal.
    gain = np.where(ok, np.round(np.where(ok, gain, 0.0), 9), 0.0).reshape(len(sums), -1)
    best = gain.argmax(axis=1)
    found = gain[np.arange(len(gain)), best] > 0
    return np.where(found, best // (BINS - 1), -1), best % (BINS - 1)


def _step(
    plan: Plan, rows: Rows, n: np.ndarray, inputs: np.ndarray, level: int, members: tuple, tests: tuple,
    totals: np.ndarray, sums_of: Callable[[np.ndarray], np.ndarray],
) -> tuple[np.ndarray, np.ndarray, tuple, np.ndarray]:
    """What the model of each subject does at each node that its rows reach.

    ``members`` and ``tests`` are (node, row): the drawn rows, of the visiting subjects at least, and the
    rows on their way down their own subject's model. Gives which tests end here, their shares of the classes, and for
    the others the (node, feature, cut, gaps left, side) they go on by, with the place of each test among these.
    """
    (mnode, mrow), (tnode, trow) = members, tests
    subjects = len(rows.number)
    pairs, of = np.unique(tnode * subjects + rows.sub[trow], return_inverse=True)
    pnode, psub = pairs // subjects, pairs % subjects
    key = mnode * subjects + rows.sub[mrow]
    at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
    own = pairs[at] == key
    order = np.argsort(at[own], kind="stable")
    opair, onode, orow = at[own][order], mnode[own][order], mrow[own][order]
    left = totals[pnode] - np.bincount(opair * plan.classes + rows.y[orow], n[orow], minlength=len(pairs) * plan.classes).reshape(-1, plan.classes)
    feature, cut = np.full(len(pairs), -1), np.zeros(len(pairs), np.int64)
    open_ = np.flatnonzero((left > 0).sum(axis=1) > 1) if level < plan.depth else np.zeros(0, np.int64)
    if len(open_):
        some = np.zeros(len(inputs), bool)
        some[pnode[open_]] = True
        sums = sums_of(some)
        for begin in range(0, len(open_), PAIRS):
            chosen = open_[begin : begin + PAIRS]
            first, last = np.searchsorted(opair, [chosen[0], chosen[-1] + 1])
            place = np.minimum(np.searchsorted(chosen, opair[first:last]), len(chosen) - 1)
            used = chosen[place] == opair[first:last]
            node, row = onode[first:last][used], orow[first:last][used]
            apart = sums[pnode[chosen]] - _histogram(plan, rows, inputs, node, row, n[row], place[used], len(chosen))
            fill = np.take_along_axis(rows.fill[psub[chosen]], inputs[pnode[chosen]], axis=1)
            gaps, apart = apart[:, :, BINS].copy(), apart[:, :, :BINS]
            apart[np.arange(len(chosen))[:, None], np.arange(inputs.shape[1])[None, :], fill] += gaps
            slot, cut[chosen] = _best(apart, rows.weight[psub[chosen]])
            feature[chosen] = np.where(slot < 0, -1, inputs[pnode[chosen], slot])
    weighted = left * rows.weight[psub]
    shares = weighted / np.maximum(weighted.sum(axis=1, keepdims=True), 1e-300)
    ends = feature[of] < 0
    on = of[~ends]
    j, c = feature[on], cut[on]
    gaps_left = rows.fill[psub[on], j] <= c
    code = rows.codes[j, trow[~ends]]
    side = 1 - np.where(code == BINS, gaps_left, code <= c)
    keys, to = np.unique((((pnode[on] * plan.width + j) * BINS + c) * 2 + gaps_left) * 2 + side, return_inverse=True)
    rest, side = keys // 2, keys % 2
    rest, gaps_left = rest // 2, rest % 2
    rest, c = rest // BINS, rest % BINS
    return ends, shares[of[ends]], (rest // plan.width, rest % plan.width, c, gaps_left, side), to


def _kept(rows: Rows, row: np.ndarray, j, c, gaps_left, side) -> np.ndarray:
    """Rows that a split sends to a side."""
    code = rows.codes[j, row]
    return np.where(code == BINS, gaps_left == 1, code <= c) == (side == 0)


def _grow(plan: Plan, rows: Rows, tree: int, heap: int, level: int, n: np.ndarray, test: np.ndarray) -> np.ndarray:
    """Class shares at the ends of the paths of the ``test`` rows, from a node down; zeros for the others."""
    votes = np.zeros((len(rows.y), plan.classes))
    member, tested = np.flatnonzero(n > 0), np.flatnonzero(test)
    if not len(tested):
        return votes
    nothing = np.zeros(1, np.int64)
    # A node's rows are picked out of its parent's when its turn comes, which bounds what is held by the depth.
    waiting = [(level, np.array([heap]), None, (nothing, np.array([0, len(member)]), member), (np.zeros(len(tested), np.int64), tested))]
    while waiting:
        level, heaps, splits, (parent, starts, member), (tnode, trow) = waiting.pop()
        lengths = starts[parent + 1] - starts[parent]
        mnode = np.repeat(np.arange(len(parent)), lengths)
        begin = np.cumsum(lengths) - lengths
        mrow = member[np.arange(len(mnode)) + np.repeat(starts[parent] - begin, lengths)]
        if splits is not None:
            kept = _kept(rows, mrow, *[s[mnode] for s in splits])
            mnode, mrow = mnode[kept], mrow[kept]
        inputs = plan.inputs(tree, heaps)
        totals = np.bincount(mnode * plan.classes + rows.y[mrow], n[mrow], minlength=len(heaps) * plan.classes).reshape(-1, plan.classes)

        def sums_of(some: np.ndarray) -> np.ndarray:
            used = some[mnode]
            return _histogram(plan, rows, inputs, mnode[used], mrow[used], n[mrow[used]])

        ends, shares, (node, *rest), to = _step(plan, rows, n, inputs, level, (mnode, mrow), (tnode, trow), totals, sums_of)
        votes[trow[ends]] = shares
        if not len(node):
            continue
        order = np.argsort(to, kind="stable")
        to, on = to[order], trow[~ends][order]
        starts = np.searchsorted(mnode, np.arange(len(heaps) + 1))
        size = np.cumsum(starts[node + 1] - starts[node] + 600)  # a node's sums count too
        piece = size // PIECE
        for k in np.unique(piece):
            first, last = np.searchsorted(piece, [k, k + 1])
            a, b = np.searchsorted(to, [first, last])
            part = slice(first, last)
            below = (2 * heaps[node[part]] + 1 + rest[-1][part], [r[part] for r in rest], (node[part], starts, mrow), (to[a:b] - first, on[a:b]))
            waiting.append((level + 1, *below))
    return votes


def _walk(plan: Plan, rows: Rows, top: list[Top], root: int) -> Iterator[tuple[int, str, object]]:
    """Rows from the root of a tree through the nodes above: what is found at the others, by node.

    Yields ("rows", (drawn, test)) at nodes without sums, ("votes", (rows, shares)) where paths end above them, and
    ("split", (feature, cut, gaps left, side)) where a path needs a node that is not there yet.
    """
    n = rows.drawn(top[root].tree)
    waiting = [(root, np.flatnonzero(n > 0), np.arange(len(rows.y)))]
    while waiting:
        number, member, tested = waiting.pop()
        at = top[number]
        if at.sums is None:
            yield number, "rows", (n, member, tested)
            continue
        inputs = plan.inputs(at.tree, np.array([at.heap]))
        none = (np.zeros(len(member), np.int64), member), (np.zeros(len(tested), np.int64), tested)
        totals = at.sums[:, 0].sum(axis=1)
        reached = {}
        if len(tested):
            ends, shares, (_, *rest), to = _step(plan, rows, n, inputs, at.level, *none, totals, lambda _: at.sums)
            if ends.any():
                yield number, "votes", (tested[ends], shares)
            for i, split in enumerate(zip(*[r.tolist() for r in rest])):
                reached[split] = tested[~ends][to == i]
                if split not in at.split:
                    yield number, "split", split
        for split, below in at.split.items():
            waiting.append((below, member[_kept(rows, member, *split)], reached.get(split, np.zeros(0, np.int64))))


_SUBJECT = "_n int, _seed bigint, y binary, codes binary, fill binary"


def _subject_rows(rows: DataFrame, subject: str, features: Sequence[str], edges: list[np.ndarray], classes: int) -> DataFrame:
    """One row per subject with its rows packed, and the codes of its medians."""
    middles = _middles(rows, subject, features)

    def pack(table: pa.Table) -> pa.Table:
        x = np.column_stack([table.column(f"_x{i}").to_numpy().astype(float) for i in range(len(features))])
        y = table.column("_y").to_numpy().astype(np.int8)
        order = np.lexsort((*np.nan_to_num(x, nan=-np.inf).T, y, table.column("_key").to_numpy()))
        x, y = x[order], y[order]
        codes = codes_of(edges, x)
        fill = codes_of(edges, np.array([[_median_without(m, np.sort(v[~np.isnan(v)])) for m, v in zip(middles, x.T)]]))
        packed = {"_s": table.column("_s")[:1], "_n": pa.array([len(y)], pa.int32()), "_seed": table.column("_seed")[:1]}
        packed |= {"y": [y.tobytes()], "codes": [np.where(codes == MISSING, BINS, codes).astype(np.uint8).tobytes()], "fill": [fill.tobytes()]}
        return pa.table(packed)

    numbers = [F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]
    spread = rows.select(
        F.col(subject).alias("_s"), F.xxhash64(subject).alias("_seed"), F.xxhash64("row_id").alias("_key"), F.col("label_index").cast("int").alias("_y"), *numbers
    )
    kind = spread.schema["_s"].dataType.simpleString()
    packed = spread.groupBy("_s").applyInArrow(pack, f"_s {kind}, {_SUBJECT}")
    return cut_lineage(packed.withColumn("_g", F.monotonically_increasing_id()))


def _middles(rows: DataFrame, subject: str, features: Sequence[str]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per feature the number of values, the distinct ones around the middle, and how many lie at or below each.

    Without a subject of m values the median moves by at most m ranks, so that the driver gets about as many
    values a feature as the largest subject has.
    """
    own = rows.groupBy(subject).agg(*[F.count(f).alias(f"n{i}") for i, f in enumerate(features)])
    sizes = own.agg(*[g(f"n{i}").alias(f"{name}{i}") for i in range(len(features)) for name, g in (("sum", F.sum), ("max", F.max))]).first()
    ends = {}
    for i, f in enumerate(features):
        n, most = sizes[f"sum{i}"] or 0, sizes[f"max{i}"] or 0
        if n:
            first, last = max(0, (n - most - 1) // 2 - 1), min(n - 1, (n + most) // 2 + 2)
            ends[f] = (first / max(n - 1, 1), last / max(n - 1, 1))
    found: dict[str, dict] = {f: {} for f in features}
    if ends:
        shares = sorted({s for pair in ends.values() for s in pair})
        at = {(r["feature"], r["share"]): r["quantile"] for r in ordering.quantiles(rows, list(ends), shares).collect()}
        # A little wider, since interpolated values are rounded.
        sides = [[(f, at[f, pair[side]] + sign * 1e-9 * abs(at[f, pair[side]])) for f, pair in ends.items()] for side, sign in ((0, -1), (1, 1))]
        low, high = (F.create_map(*[F.lit(x) for pair in side for x in pair])[F.col("feature")] for side in sides)
        value = F.col("value")
        middle = ordering.melt(rows, list(ends)).where(value <= high).select("feature", F.when(value >= low, value).alias("value"))
        for r in middle.groupBy("feature", "value").agg(F.count("*").alias("n")).collect():
            found[r["feature"]][r["value"]] = r["n"]
    out = []
    for i, f in enumerate(features):
        below = found[f].pop(None, 0)
        values = sorted(found[f])
        out.append((sizes[f"sum{i}"] or 0, np.array(values, float), below + np.cumsum([found[f][v] for v in values])))
    return out


def _median_without(middle: tuple[int, np.ndarray, np.ndarray], own: np.ndarray) -> float:
    """Median of a feature without the sorted values of a subject; zero if there are no others."""
    n, values, ahead = middle
    n -= len(own)
    if n <= 0:
        return 0.0
    left = ahead - np.searchsorted(own, values, side="right")
    low, high = (values[np.searchsorted(left, rank, side="right")] for rank in ((n - 1) // 2, n // 2))
    share = (n - 1) / 2 % 1
    return float(low * (1 - share) + high * share)


def _joined(kind, column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _rows_of(plan: Plan, batch: pa.RecordBatch, counts: np.ndarray) -> Rows:
    """Rows of a batch of subjects; ``counts`` are those of all rows by class."""
    sizes = batch.column("_n").to_numpy()
    y = _joined(np.int8, batch.column("y")).astype(np.int64)
    sub = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(y)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = counts - np.bincount(sub * plan.classes + y, minlength=len(sizes) * plan.classes).reshape(-1, plan.classes)
    known = (left > 0).sum(axis=1, keepdims=True)
    weight = np.where(left > 0, left.sum(axis=1, keepdims=True) / np.maximum(known * left, 1), 1.0)
    codes = np.ascontiguousarray(_joined(np.uint8, batch.column("codes")).reshape(-1, plan.width).T).astype(np.int64)
    fill = _joined(np.uint8, batch.column("fill")).reshape(-1, plan.width).astype(np.int64)
    return Rows(codes, y, sub, place, batch.column("_g").to_numpy(), batch.column("_seed").to_numpy().view(np.uint64), fill, weight)


_UNIT = "unit int, codes binary, y binary, sub binary, place binary, n binary, test binary, number binary, fill binary, weight binary"
_KINDS = {"y": np.int8, "sub": np.int32, "place": np.int32, "n": np.uint8, "test": np.bool_, "number": np.int64, "fill": np.uint8, "weight": float}


def _unit(rows: Rows, unit: int, n: np.ndarray, member: np.ndarray, tested: np.ndarray) -> dict:
    test = np.zeros(len(rows.y), bool)
    test[tested] = True
    used = np.union1d(member, tested)
    present, sub = np.unique(rows.sub[used], return_inverse=True)
    out = {"y": rows.y[used], "sub": sub, "place": rows.place[used], "n": n[used], "test": test[used]}
    out |= {"number": rows.number[present], "fill": rows.fill[present], "weight": rows.weight[present]}
    return {"unit": unit, "codes": rows.codes[:, used].T.astype(np.uint8).tobytes()} | {k: v.astype(_KINDS[k]).tobytes() for k, v in out.items()}


def _unit_rows(plan: Plan, table: pa.Table) -> tuple[Rows, np.ndarray, np.ndarray]:
    got = {k: [np.frombuffer(v, kind) for v in table.column(k).to_pylist()] for k, kind in _KINDS.items()}
    ahead = np.cumsum([0, *[len(v) for v in got["number"]]])
    sub = np.concatenate([s.astype(np.int64) + a for s, a in zip(got.pop("sub"), ahead)])
    whole = {k: np.concatenate(v) for k, v in got.items()}
    codes = np.ascontiguousarray(_joined(np.uint8, table.column("codes")).reshape(-1, plan.width).T).astype(np.int64)
    fill, weight = whole["fill"].reshape(-1, plan.width).astype(np.int64), whole["weight"].reshape(-1, plan.classes)
    rows = Rows(codes, whole["y"].astype(np.int64), sub, whole["place"].astype(np.int64), whole["number"], np.zeros(0, np.uint64), fill, weight)
    return rows, whole["n"].astype(np.int64), whole["test"]


def left_out(rows: DataFrame, subject: str, features: Sequence[str], classes: int, params: dict) -> DataFrame:
    """(subject, label_index, prediction) of each of ``rows`` by the forest of all other subjects' rows.

    ``rows`` have the features, label_index and row_id; a subject's rows are held by one task.
    """
    spark = rows.sparkSession
    depth = 30 if params["max_depth"] is None else params["max_depth"]
    plan = Plan(len(features), classes, params["n_estimators"], depth)
    counts = np.zeros(classes)
    for r in rows.groupBy("label_index").agg(F.count("*").alias("n")).collect():
        counts[int(r["label_index"])] = r["n"]
    if not counts.sum():
        return rows.select(subject, "label_index", F.lit(None).cast("double").alias("prediction"))
    edges = split_values(rows, features, BINS)
    kept = _subject_rows(rows, subject, features, edges, classes)
    top = [Top(t, 0, 0, counts.sum()) for t in range(plan.trees)]
    while _add_level(plan, kept, top, counts):
        pass
    tasks = min(MOST_TASKS, len(top))
    names = [f"v{k}" for k in range(classes)]
    schema = "_g bigint, place int, y int, " + ", ".join(f"{v} bigint" for v in names)

    def votes(rows: Rows, at: np.ndarray, shares: np.ndarray) -> dict:
        parts = np.floor(shares * ONE).astype(np.int64)
        found = {"_g": rows.number[rows.sub[at]], "place": rows.place[at].astype(np.int32), "y": rows.y[at].astype(np.int32)}
        return found | {v: parts[:, k] for k, v in enumerate(names)}

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _rows_of(plan, batch, counts)
            for root in range(plan.trees):
                found = [_unit(own, u, *what) for u, kind, what in _walk(plan, own, top, root) if kind == "rows" and len(what[1]) + len(what[2])]
                if found:
                    yield pa.RecordBatch.from_pylist(found, pa.schema([("unit", pa.int32()), *[(c.split()[0], pa.binary()) for c in _UNIT.split(", ")[1:]]]))

    def finish(table: pa.Table) -> pa.Table:
        unit = table.column("unit")[0].as_py()
        own, n, test = _unit_rows(plan, table)
        shares = _grow(plan, own, top[unit].tree, top[unit].heap, top[unit].level, n, test)
        at = np.flatnonzero(test)
        return pa.table(votes(own, at, shares[at]))

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _rows_of(plan, batch, counts)
            for root in range(plan.trees):
                for _, kind, what in _walk(plan, own, top, root):
                    if kind == "votes":
                        yield pa.RecordBatch.from_pydict(votes(own, *what))

    found = kept.mapInArrow(units, _UNIT).repartition(tasks, "unit").groupBy("unit").applyInArrow(finish, schema)
    if any(node.sums is not None for node in top):
        found = found.unionByName(kept.mapInArrow(above, schema))
    summed = found.groupBy("_g", "place").agg(F.first("y").alias("y"), *[F.sum(v).alias(v) for v in names])
    # The first of equal votes wins.
    said = F.array_position(F.array(*names), F.greatest(*names) if classes > 1 else F.col(names[0])) - 1
    named = summed.join(kept.select("_g", F.col("_s").alias(subject)), "_g")
    return named.select(subject, F.col("y").cast("double").alias("label_index"), said.cast("double").alias("prediction"))


def _add_level(plan: Plan, kept: DataFrame, top: list[Top], counts: np.ndarray) -> bool:
    """Sum the nodes of more than LIMIT rows over all tasks and add the nodes that models go on to; False if there is none."""
    large = {i for i, node in enumerate(top) if node.sums is None and node.size > LIMIT and node.level < plan.depth}
    if not large:
        return False
    roots = sorted({top[i].tree for i in large})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = _rows_of(plan, batch, counts)
            for root in roots:
                for unit, kind, what in _walk(plan, rows, top, root):
                    if kind == "rows" and unit in large:
                        n, member, _ = what
                        inputs = plan.inputs(top[unit].tree, np.array([top[unit].heap]))
                        own = _histogram(plan, rows, inputs, np.zeros(len(member), np.int64), member, n[member])
                        totals[unit] = totals[unit] + own if unit in totals else own
        yield pa.RecordBatch.from_pydict({"unit": pa.array(list(totals), pa.int32()), "sums": pa.array([v.tobytes() for v in totals.values()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(v) for v in table.column("sums").to_pylist())
        return pa.table({"unit": table.column("unit")[:1], "sums": [whole.tobytes()]})

    schema = "unit int, sums binary"
    for r in kept.mapInArrow(sums, schema).groupBy("unit").applyInArrow(add, schema).collect():
        top[r.unit].sums = np.frombuffer(r.sums).reshape(1, -1, BINS + 1, plan.classes)

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = set()
        for batch in batches:
            rows = _rows_of(plan, batch, counts)
            for root in roots:
                wanted |= {(unit, *what) for unit, kind, what in _walk(plan, rows, top, root) if kind == "split"}
        names = ("unit", "feature", "cut", "gaps_left", "side")
        yield pa.RecordBatch.from_pydict({name: pa.array([w[i] for w in wanted], pa.int32()) for i, name in enumerate(names)})

    wanted = kept.mapInArrow(splits, "unit int, feature int, cut int, gaps_left int, side int").distinct()
    for unit, feature, cut, gaps_left, side in sorted(tuple(r) for r in wanted.collect()):
        node = top[unit]
        inputs = plan.inputs(node.tree, np.array([node.heap]))[0]
        by_code = node.sums[0, list(inputs).index(feature)].sum(axis=1)
        left = by_code[: cut + 1].sum() + gaps_left * by_code[BINS]
        node.split[feature, cut, gaps_left, side] = len(top)
        top.append(Top(node.tree, node.level + 1, 2 * node.heap + 1 + side, by_code.sum() - left if side else left))
    return True
