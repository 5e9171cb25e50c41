"""Families whose candidates and folds are trained together.

Each takes the rows once, as blocks of a fleet, and gives the macro-F1 of every
candidate on every group left out, and on demand a model of all rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions import ordering
from panelloom.models import boosting, fleet, kernel, linear, network
from panelloom.models.fleet import NOBODY, Layout

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEAR = 1_000  # rows of a group left out; the driver gets about 1.5 times as many values a feature
ACCURACY = 10_000  # estimated ranks are wrong by a row in so many, at most
MANY = 64  # groups left out whose models keep more tasks busy than there are blocks


class ArrayModel(Model):
    """Predicted codes from raw feature columns, by a function of an array with gaps as NaN."""

    def __init__(self, features: Sequence[str], codes: Callable[[np.ndarray], np.ndarray]) -> None:
        super().__init__()
        self.features, self.codes = list(features), codes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        codes = self.codes

        @F.pandas_udf("double")
        def predict(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float, na_value=np.nan) for c in columns])
            return pd.Series(codes(x).astype(float)) if len(x) else pd.Series([], dtype=float)

        return dataset.withColumn("prediction", predict(*[F.col(f).cast("double") for f in self.features]))


class Shared:
    """Training rows (features, label_index, group code) and what all families need of them."""

    def __init__(self, rows: DataFrame, features: Sequence[str], classes: int, group: str | None = None, outs: Sequence[int] = ()) -> None:
        self.features, self.classes, self.outs = tuple(features), classes, list(outs)
        self.rows = rows.withColumn("_group", F.col(group).cast("int") if group else F.lit(0)).where(F.col("label_index").isNotNull())

    @property
    def width(self) -> int:
        return len(self.features)

    @cached_property
    def blocks(self) -> fleet.Blocks:
        at_once = 0.25 if len(self.outs) > MANY else 1 if self.outs else 4
        return fleet.pack(self.rows, self.features, "label_index", "_group", at_once)

    @cached_property
    def layout(self) -> Layout:
        """Exact medians of the rows each model learns from; a row counts for all models but its own group's."""
        return Layout(self.features, self.classes, (self._near_medians() if self.outs else None) or self._counted_medians())

    def _counted_medians(self) -> dict[int, np.ndarray]:
        """From counts by group, which are repeated once per group left out."""
        medians = {o: np.zeros(self.width) for o in [NOBODY, *self.outs]}
        place = {f: i for i, f in enumerate(self.features)}
        for r in ordering.medians_without(self.rows, list(self.features), "_group", list(medians)).collect():
            if r["quantile"] is not None:
                medians[r["_out"]][place[r["feature"]]] = r["quantile"]
        return medians

    def _near_medians(self) -> dict[int, np.ndarray] | None:
        """The same from values around the middle: without m rows it moves by at most m ranks.

        The driver gets the distinct values within the most such ranks, by group
        left out; None if these are more than NEAR. Where these values lie is estimated and
        a little wider; how many lie below them is counted.
        """
        known = ordering.melt(self.rows, self.features, ["_group"])
        code = F.when(F.col("_group").isin(self.outs), F.col("_group")).otherwise(F.lit(NOBODY))
        sizes: dict[str, dict[int, int]] = {}
        for r in known.groupBy("feature", code.alias("code")).agg(F.count("*").alias("n")).collect():
            sizes.setdefault(r["feature"], {})[r["code"]] = r["n"]
        if max((n for s in sizes.values() for c, n in s.items() if c != NOBODY), default=0) > NEAR:
            return None
        ends = {}
        for f, own in sizes.items():
            n, most = sum(own.values()), max((m for c, m in own.items() if c != NOBODY), default=0)
            spare = n // ACCURACY + 2
            first, last = max(0, (n - most - 1) // 2 - spare), min(n - 1, (n + most) // 2 + spare)
            ends[f] = (first / max(n - 1, 1), last / max(n - 1, 1))
        medians = {o: np.zeros(self.width) for o in [NOBODY, *self.outs]}
        if not ends:
            return medians
        shares = [F.array(*[F.lit(s) for s in pair]) for pair in ends.values()]
        about = self.rows.agg(*[F.percentile_approx(F.col(f).cast("double"), s, ACCURACY) for f, s in zip(ends, shares)]).first()
        # Values of the first and the last ranks end them all.
        limits = [
            [(f, sign * float("inf") if pair[side] == side else at[side]) for (f, pair), at in zip(ends.items(), about)]
            for side, sign in ((0, -1), (1, 1))
        ]
        low, high = (F.create_map(*[F.lit(x) for pair in side for x in pair])[F.col("feature")] for side in limits)
        value = F.col("value")
        middle = known.where(value <= high).select("feature", code.alias("code"), F.when(value >= low, value).alias("value"))
        found: dict[str, list] = {f: [] for f in ends}
        for r in middle.groupBy("feature", "code", "value").agg(F.count("*").alias("n")).collect():
            found[r["feature"]].append(r)
        for f, rows in found.items():
            values = np.array(sorted({r["value"] for r in rows if r["value"] is not None}))
            counts = {c: np.zeros(len(values) + 1) for c in {NOBODY, *sizes[f]}}  # below the values, then at each
            for r in rows:
                counts[r["code"]][0 if r["value"] is None else 1 + np.searchsorted(values, r["value"])] += r["n"]
            whole, total = sum(counts.values()), sum(sizes[f].values())
            for o in medians:
                n = total - (sizes[f].get(o, 0) if o != NOBODY else 0)
                if n:
                    ahead = np.cumsum(whole - (counts[o] if o != NOBODY and o in counts else 0))[1:]
                    lower = whole[0] - (counts[o][0] if o != NOBODY and o in counts else 0)
                    if not (len(values) and lower <= (n - 1) // 2 and n // 2 < ahead[-1]):
                        return None  # the estimate was further off
                    below, above = (values[np.searchsorted(ahead, rank, side="right")] for rank in ((n - 1) // 2, n // 2))
                    share = (n - 1) / 2 % 1
                    medians[o][self.features.index(f)] = below * (1 - share) + above * share
        return medians

    @cached_property
    def scaled(self) -> linear.Scaling:
        return linear.scaling(self.blocks, self.layout, [NOBODY, *self.outs])

    @cached_property
    def edges(self) -> list[np.ndarray]:
        return boosting.split_values(self.rows, self.features)

    def model(self, codes: Callable[[np.ndarray], np.ndarray]) -> ArrayModel:
        return ArrayModel(self.features, codes)


class Result:
    """``confusions[candidate][group left out]`` and the model of a candidate on all rows."""

    def __init__(self, confusions: list[dict[int, np.ndarray]], refit: Callable[[int], Model]) -> None:
        self.confusions, self.refit = confusions, refit

    def scores(self, outs: Sequence[int]) -> list[list[float]]:
        return [[fleet.macro_f1(c[o]) for o in outs if o in c] for c in self.confusions]


def logistic(shared: Shared, candidates: Sequence[dict], whole: bool = True) -> Result:
    outs = [*shared.outs, *([NOBODY] if whole else [])]
    settings = [(p["C"], o) for p in candidates for o in outs]
    weights = dict(zip(settings, linear.train(shared.blocks, shared.scaled, settings, candidates[0].get("max_iter", 100))))
    models = [(o, linear.predictor(shared.scaled, weights[s], o)) for s in settings for o in [s[1]]]
    return _result(shared, candidates, outs, models, lambda i: models[i * len(outs) + outs.index(NOBODY)][1])


def mlp(shared: Shared, candidates: Sequence[dict], whole: bool = True) -> Result:
    outs = [*shared.outs, *([NOBODY] if whole else [])]
    networks = [network.Network(tuple(p["hidden_layer_sizes"]), p["alpha"], o) for p in candidates for o in outs]
    flat = network.train(shared.blocks, shared.scaled, networks, candidates[0].get("max_iter", 3000))
    models = [(n.out, network.predictor(shared.scaled, n, f)) for n, f in zip(networks, flat)]
    return _result(shared, candidates, outs, models, lambda i: models[i * len(outs) + outs.index(NOBODY)][1])


def svm(shared: Shared, candidates: Sequence[dict], whole: bool = True) -> Result:
    """Linear and Gaussian machines of all costs; ``width`` landmarks stand for the Gaussian kernel."""
    outs = [*shared.outs, *([NOBODY] if whole else [])]
    widths = [p.get("width", kernel.WIDTH) if p["kernel"] == "rbf" else 0 for p in candidates]
    maps = {
        (w, o): found
        for w in sorted(set(widths) - {0})
        for o, found in kernel.landmarks(shared.rows, "_group", shared.blocks, shared.scaled, outs, w).items()
    }
    pairs = kernel.pairs(shared.classes)
    machines = [kernel.Machine(p["C"], w, o, *pair) for p, w in zip(candidates, widths) for o in outs for pair in pairs]
    weights = kernel.train(shared.blocks, shared.scaled, maps, machines, candidates[0].get("max_iter", 200))
    models = []
    for at in range(0, len(machines), len(pairs)):
        own = slice(at, at + len(pairs))
        models.append((machines[at].out, kernel.predictor(shared.scaled, maps, machines[own], weights[own])))
    return _result(shared, candidates, outs, models, lambda i: models[i * len(outs) + outs.index(NOBODY)][1])


def _result(shared, candidates, outs, models, chosen) -> Result:
    found = linear.confusions(shared.blocks, shared.width, shared.classes, models) if shared.outs else {}
    by_candidate = [{o: found[i * len(outs) + j] for j, o in enumerate(outs) if i * len(outs) + j in found} for i in range(len(candidates))]
    return Result(by_candidate, lambda i: shared.model(chosen(i)))


def gradient_boosting(shared: Shared, candidates: Sequence[dict], whole: bool = True) -> Result:
    """Candidates that differ in their number of rounds are one booster, scored on the way."""
    outs = [*shared.outs, *([NOBODY] if whole else [])]
    kinds = list(dict.fromkeys((p["max_depth"], p["learning_rate"]) for p in candidates))
    boosters = [boosting.Booster(d, r, o) for d, r in kinds for o in outs]
    stages = sorted({p["n_estimators"] for p in candidates})
    ensemble, found = boosting.train(shared.blocks, shared.layout, shared.edges, boosters, stages[-1], stages if shared.outs else ())
    first = [kinds.index((p["max_depth"], p["learning_rate"])) * len(outs) for p in candidates]
    confusions = [
        {o: found[p["n_estimators"]][f + j] for j, o in enumerate(outs) if o != NOBODY and f + j in found.get(p["n_estimators"], {})}
        for p, f in zip(candidates, first)
    ]

    def refit(i: int) -> Model:
        rounds = candidates[i]["n_estimators"]
        own = ensemble.only(first[i] + outs.index(NOBODY), rounds)
        return shared.model(lambda x: own.scores(x, 0, rounds).argmax(axis=1))

    return Result(confusions, refit)


FLEETS = {"logistic_regression": logistic, "mlp": mlp, "gradient_boosting": gradient_boosting, "svm": svm}
