"""Every family on labels that the features decide."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelloom.models import families, tuning
from panelloom.models.evaluate import MacroF1Evaluator
from panelloom.operators.validate import require_temporal_design
from panelloom.plans.catalog import learning
from panelloom.spec import WEARABLE, PanelSpec, cumulative_conditions

SPEC = PanelSpec(groups={"g": ("x", "y")})
CENTRES = {"Low": (-3.0, 0.0), "Medium": (3.0, 0.0), "High": (0.0, 4.0)}
SETTINGS = {
    "logistic_regression": {"C": 1.0, "max_iter": 30},
    "svm": {"C": 1.0, "kernel": "rbf", "max_iter": 20, "width": 40},
    "knn": {"n_neighbors": 3},
    "random_forest": {"n_estimators": 5, "max_depth": 4},
    "gradient_boosting": {"n_estimators": 3, "learning_rate": 0.1, "max_depth": 2},
    "mlp": {"hidden_layer_sizes": [8], "alpha": 0.001, "max_iter": 60},
}


@pytest.fixture(scope="module")
def parts(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        label = rng.choice(list(CENTRES))
        a, b = CENTRES[label]
        x = None if rng.random() < 0.05 else rng.gauss(a, 0.5)
        rows.append((f"s{i % 12}", dt.date(2024, 1, 1) + dt.timedelta(days=i), label, x, rng.gauss(b, 0.5)))
    frame = spark.createDataFrame(rows, "subject_id string, day date, label string, x double, y double").persist()
    held = F.col("subject_id").isin("s0", "s1", "s2")
    return frame.where(~held), frame.where(held)


@pytest.mark.parametrize("name", list(SETTINGS))
def test_families_learn_and_keep_keys(parts, name):
    train, test = parts
    got = tuning.fit_predict(train, test, SPEC, ["x", "y"], families.FAMILIES[name], SETTINGS[name])
    assert got.columns == ["subject_id", "day", "label", "prediction"] and got.count() == test.count()
    assert MacroF1Evaluator().evaluate(got) > 0.85


def test_test_rows_do_not_influence_the_fit(parts):
    train, test = parts
    shifted = test.withColumn("y", F.col("y") + 1000)
    fit = lambda t: tuning.fit_predict(
        train, t, SPEC, ["x", "y"], families.FAMILIES["random_forest"], SETTINGS["random_forest"])
    first = fit(test.union(shifted.where("subject_id = 's0'").withColumn("subject_id", F.lit("z"))))
    again = fit(test)
    assert sorted(first.where("subject_id <> 'z'").collect()) == sorted(again.collect())


def test_full_grids_have_the_published_sizes():
    sizes = {name: len(family.candidates()) for name, family in families.FAMILIES.items()}
    assert sizes == {"majority_baseline": 1, "logistic_regression": 3, "svm": 6, "knn": 3, "random_forest": 6,
                     "gradient_boosting": 8, "mlp": 6}
    assert sum(sizes.values()) == 33


def test_cumulative_sets_grow():
    sizes = [len(c) for c in cumulative_conditions(WEARABLE).values()]
    assert sizes == [12, 13, 15, 18, 21, 24]


def test_incomplete_temporal_design_is_refused(spark):
    frame = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    with pytest.raises(ValueError, match="incomplete"):
        require_temporal_design(frame, {"base": ["x", "y"]}, SPEC)


def test_model_comparison_takes_every_family(monkeypatch):
    seen = {}
    monkeypatch.setattr(learning.panels, "split_panel", lambda *_: None)
    monkeypatch.setattr(learning, "_parts", lambda _: (None, None))
    monkeypatch.setattr(tuning, "compare_models", lambda *args: seen.update(args[4]))
    monkeypatch.setattr(tuning, "best_against_baseline", lambda _: None)
    learning.model_comparison(None, None)
    assert seen == families.FAMILIES and len(seen) == 7
