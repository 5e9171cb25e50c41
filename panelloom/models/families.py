"""The model families that are compared.

A family names its preprocessing, its parameter grid and how to build the
classifier: a Spark ML estimator per setting, or one trainer of all settings.  Inputs are ``features`` (vector), ``label_index`` (alphabetical
code) and ``weight``; output is ``prediction`` (code).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.models import grove, together
from panelloom.models.knn import NearestNeighbourClassifier
from panelloom.operators.prep import MedianImputer, PopulationScaler
from panelloom.session import ensure_checkpoint_dir
from panelloom.spec import LABELS, SEED

CLASSES = sorted(LABELS)


class MajorityClassifier(Estimator):
    """Always the most frequent label, the alphabetically first on a tie."""

    def _fit(self, dataset: DataFrame) -> "ConstantModel":
        counts = dataset.groupBy("label_index").agg(F.count("*").alias("n"))
        return ConstantModel(counts.agg(F.min_by("label_index", F.struct(-F.col("n"), "label_index"))).first()[0])


class ConstantModel(Model):
    def __init__(self, code: float) -> None:
        super().__init__()
        self.code = code

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("prediction", F.lit(float(self.code)))


def _knn(params: dict, inputs: int, rows: float) -> Estimator:
    return NearestNeighbourClassifier(params["n_neighbors"])


def _forest(params: dict, inputs: int, rows: float) -> Estimator:
    # Spark trees stop at depth 30, which stands in for "no limit".
    return RandomForestClassifier(
        featuresCol="features",
        labelCol="label_index",
        weightCol="weight",
        numTrees=params["n_estimators"],
        maxDepth=30 if params["max_depth"] is None else params["max_depth"],
        featureSubsetStrategy="sqrt",
        seed=SEED,
    )


@dataclass(frozen=True)
class Family:
    """A Spark estimator to build for a setting, or a trainer of all settings and folds together.

    ``left_out`` predicts every subject's rows by a model of all others, for all subjects at once.
    """

    build: Callable[[dict, int, float], Estimator] | None = None
    grid: dict[str, list[Any]] = field(default_factory=dict)
    scaled: bool = False
    together: Callable[..., together.Result] | None = None
    left_out: Callable[..., DataFrame] | None = None

    def candidates(self) -> list[dict[str, Any]]:
        """All settings of the grid."""
        names = sorted(self.grid)
        return [dict(zip(names, v)) for v in itertools.product(*[self.grid[n] for n in names])]


# The parameter grids of the comparison.
FAMILIES: dict[str, Family] = {
    "majority_baseline": Family(lambda p, i, r: MajorityClassifier()),
    "logistic_regression": Family(None, {"C": [0.1, 1.0, 10.0]}, True, together.logistic),
    "svm": Family(None, {"C": [0.1, 1.0, 10.0], "kernel": ["linear", "rbf"]}, True, together.svm),
    "knn": Family(_knn, {"n_neighbors": [3, 5, 9]}, True),
    "random_forest": Family(_forest, {"n_estimators": [100, 300], "max_depth": [5, 10, None]}, left_out=grove.left_out),
    "gradient_boosting": Family(
        None, {"n_estimators": [100, 200], "learning_rate": [0.05, 0.1], "max_depth": [2, 3]}, False, together.gradient_boosting
    ),
    "mlp": Family(None, {"hidden_layer_sizes": [[32], [64], [32, 16]], "alpha": [0.0001, 0.001]}, True, together.mlp),
}

# Default settings of the older, untuned comparison.
UNTUNED: dict[str, dict[str, Any]] = {
    "majority_baseline": {},
    "logistic_regression": {"C": 1.0},
    "svm": {"C": 1.0, "kernel": "rbf"},
    "random_forest": {"n_estimators": 300, "max_depth": None},
    "mlp": {"hidden_layer_sizes": [64], "alpha": 0.001},
}

# The three configurations of the robustness checks.
FIXED = {
    "all_wearable_mlp": ("mlp", {"hidden_layer_sizes": [64], "alpha": 0.001}, "all_wearable"),
    "hrv_spo2_random_forest": ("random_forest", {"n_estimators": 100, "max_depth": 10}, "hrv_spo2_only"),
    "rolling7_gradient_boosting": (
        "gradient_boosting",
        {"n_estimators": 200, "learning_rate": 0.1, "max_depth": 2},
        "rolling7_wearable",
    ),
}


def with_label_index(frame: DataFrame, label: str) -> DataFrame:
    """Alphabetical label code as double; rows without a label are dropped."""
    code = F.array_position(F.array(*[F.lit(x) for x in CLASSES]), F.col(label)) - 1
    return frame.where(F.col(label).isNotNull()).withColumn("label_index", code.cast("double"))


def with_label_text(frame: DataFrame, out: str = "prediction") -> DataFrame:
    """Predicted codes back to labels."""
    text = F.get(F.array(*[F.lit(x) for x in CLASSES]), F.col(out).cast("int"))
    return frame.withColumn(out, text)


def with_balanced_weight(train: DataFrame) -> DataFrame:
    """Weight n / (k * n_c); the label counts are one row per class."""
    counts = {r.label_index: r.n for r in train.groupBy("label_index").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for code, n in counts.items():
        weight = F.when(F.col("label_index") == code, total / (len(counts) * n)).otherwise(weight)
    return train.withColumn("weight", weight)


def preprocessing(features: Sequence[str], scaled: bool) -> Pipeline:
    stages: list[Any] = [MedianImputer(inputCols=list(features))]
    if scaled:
        stages.append(PopulationScaler(inputCols=list(features)))
    stages.append(VectorAssembler(inputCols=list(features), outputCol="features"))
    return Pipeline(stages=stages)


def fit(family: Family, params: dict, train: DataFrame, features: Sequence[str], rows: int) -> Model:
    """Preprocessing and classifier, both fitted on the given rows only."""
    if family.together is not None:
        return family.together(together.Shared(train, features, len(CLASSES)), [params]).refit(0)
    ensure_checkpoint_dir(train.sparkSession)
    prep = preprocessing(features, family.scaled).fit(train)
    ready = with_balanced_weight(prep.transform(train)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = family.build(params, len(features), float(rows)).fit(ready)
    finally:
        ready.unpersist()
    return PipelineModel(stages=[prep, model])


def feature_importance(model: PipelineModel, features: Sequence[str], train: DataFrame) -> DataFrame:
    """Impurity importance of a fitted forest, (feature, importance)."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return train.sparkSession.createDataFrame(rows, "feature string, importance double")
