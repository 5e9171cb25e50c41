"""Confusion cells and the metrics that follow from them.

Predictions are reduced to three counts per label (hits, actual, predicted)
in one grouping.  Every metric is arithmetic on those counts, which also add
up over subjects; resampling subjects therefore never touches rows again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.spec import LABELS


def count_names(labels: Sequence[str] = LABELS) -> list[str]:
    return ["n", *[f"{kind}_{x.lower()}" for kind in ("hit", "actual", "predicted") for x in labels]]


def metric_counts(
    predictions: DataFrame,
    by: Sequence[str] = (),
    actual: str = "label",
    predicted: str = "prediction",
    labels: Sequence[str] = LABELS,
) -> DataFrame:
    a, p = F.col(actual), F.col(predicted)
    columns = [F.count("*").alias("n")]
    columns += [F.count_if((a == x) & (p == x)).alias(f"hit_{x.lower()}") for x in labels]
    columns += [F.count_if(a == x).alias(f"actual_{x.lower()}") for x in labels]
    columns += [F.count_if(p == x).alias(f"predicted_{x.lower()}") for x in labels]
    return predictions.groupBy(*by).agg(*columns)


def _total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _zero_safe(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def metrics(counts: DataFrame, by: Sequence[str] = (), labels: Sequence[str] = LABELS) -> DataFrame:
    """Accuracy, macro averages over labels that occur on either side, and
    per-label F1 and support over the fixed label list."""
    names = [x.lower() for x in labels]
    hit, act, pred = (lambda x: F.col(f"hit_{x}")), (lambda x: F.col(f"actual_{x}")), (lambda x: F.col(f"predicted_{x}"))
    occurs = {x: ((act(x) + pred(x)) > 0).cast("int") for x in names}
    known = _total(list(occurs.values()))
    precision = {x: _zero_safe(hit(x), pred(x)) for x in names}
    recall = {x: _zero_safe(hit(x), act(x)) for x in names}
    f1 = {x: _zero_safe(hit(x) * 2, act(x) + pred(x)) for x in names}

    def macro(values: dict[str, Column]) -> Column:
        return F.try_divide(_total([values[x] * occurs[x] for x in names]), known)

    return counts.select(
        *by,
        _zero_safe(_total([hit(x) for x in names]), F.col("n")).alias("accuracy"),
        macro(precision).alias("macro_precision"),
        macro(recall).alias("macro_recall"),
        macro(f1).alias("macro_f1"),
        *[f1[x].alias(f"{x}_f1") for x in names],
        *[act(x).alias(f"{x}_support") for x in names],
    )


def evaluate(
    predictions: DataFrame,
    by: Sequence[str] = (),
    actual: str = "label",
    predicted: str = "prediction",
    labels: Sequence[str] = LABELS,
) -> DataFrame:
    return metrics(metric_counts(predictions, by, actual, predicted, labels), by, labels)


def per_class(
    predictions: DataFrame, actual: str = "label", predicted: str = "prediction", labels: Sequence[str] = LABELS
) -> DataFrame:
    """One row per label of the fixed list: precision, recall, F1, support."""
    counts = metric_counts(predictions, (), actual, predicted, labels)
    parts = [
        F.struct(
            F.lit(x).alias("label"),
            _zero_safe(F.col(f"hit_{x.lower()}"), F.col(f"predicted_{x.lower()}")).alias("precision"),
            _zero_safe(F.col(f"hit_{x.lower()}"), F.col(f"actual_{x.lower()}")).alias("recall"),
            _zero_safe(
                F.col(f"hit_{x.lower()}") * 2, F.col(f"actual_{x.lower()}") + F.col(f"predicted_{x.lower()}")
            ).alias("f1"),
            F.col(f"actual_{x.lower()}").alias("support"),
        )
        for x in labels
    ]
    return counts.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def hardest_class(classes: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """The label with the lowest F1, the first in the order of the labels on a tie."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label"))
    return classes.agg(F.min_by("label", F.struct(F.col("f1"), place)).alias("label"), F.min("f1").alias("f1"))


def confusion_matrix(
    predictions: DataFrame,
    by: Sequence[str] = (),
    actual: str = "label",
    predicted: str = "prediction",
    labels: Sequence[str] = LABELS,
) -> DataFrame:
    """Rows are actual labels in fixed order, one column per predicted label."""
    cells = [
        F.struct(
            F.lit(x).alias("actual"),
            *[
                F.count_if((F.col(actual) == x) & (F.col(predicted) == y)).alias(f"predicted_{y.lower()}")
                for y in labels
            ],
        )
        for x in labels
    ]
    return (
        predictions.groupBy(*by)
        .agg(F.array(*cells).alias("_rows"))
        .select(*by, F.explode("_rows").alias("_r"))
        .select(*by, "_r.*")
    )


def confusion_percent(matrix: DataFrame, by: Sequence[str] = (), labels: Sequence[str] = LABELS) -> DataFrame:
    """Counts with their share of the actual label's total."""
    names = [f"predicted_{x.lower()}" for x in labels]
    total = _total([F.col(c) for c in names])
    return matrix.select(
        *by,
        "actual",
        *names,
        *[(_zero_safe(F.col(c), total) * 100).alias(f"{c}_percent") for c in names],
    )


class MacroF1Evaluator(Evaluator):
    """Macro-averaged F1 as a Spark ML evaluator; fetches one row of counts."""

    def __init__(self, actual: str = "label", predicted: str = "prediction", labels: Sequence[str] = LABELS) -> None:
        super().__init__()
        self.actual, self.predicted, self.labels = actual, predicted, tuple(labels)

    def _evaluate(self, dataset: DataFrame) -> float:
        row = evaluate(dataset, (), self.actual, self.predicted, self.labels).first()
        return float(row.macro_f1 or 0.0)

    def isLargerBetter(self) -> bool:
        return True
