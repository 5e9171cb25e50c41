"""Forests that leave one subject out against the same forests written out plainly."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.models import boosting, families, grove, tuning
from panelloom.models.evaluate import MacroF1Evaluator
from panelloom.spec import PanelSpec

NAMES = ("a", "b", "c")
SPEC = PanelSpec(groups={"g": NAMES})
SETTING = {"n_estimators": 6, "max_depth": 4}


def panel_of(spark, subjects, n=300):
    """Rows of three classes, a smooth feature, a coarse one and one that half the rows lack."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 3)) + np.stack([y, -y, y == 1], 1) * 0.8
    x[:, 1] = np.round(x[:, 1])
    x[rng.random((n, 3)) < (0.1, 0.1, 0.5)] = np.nan
    s = rng.integers(0, subjects, n)
    days = np.arange(n)
    rows = [(f"s{k}", int(d), families.CLASSES[c], *[None if np.isnan(v) else float(v) for v in r]) for k, d, c, r in zip(s, days, y, x)]
    frame = spark.createDataFrame(rows, "subject_id string, day int, label string, a double, b double, c double")
    return frame.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), "day"))


def said_by(spark, panel, setting=SETTING):
    rows = tuning._modelling_rows(panel, SPEC, NAMES)
    found = {}
    for r in grove.left_out(rows, "subject_id", NAMES, 3, setting).collect():
        found.setdefault(r["subject_id"], Counter())[int(r["label_index"]), int(r["prediction"])] += 1
    return found


def plain_shares(plan, codes, y, n, weight, tree, heap, level, at, row):
    """Class shares at the leaf of one row: gaps are filled, nobody else's forest is looked at."""
    counts = np.bincount(y[at], n[at], minlength=3) * weight
    best = (0.0, None)
    if level < plan.depth and (counts > 0).sum() > 1:

        def loss(part):
            c = np.bincount(y[part], n[part], minlength=3) * weight
            return c.sum() - np.square(c).sum() / c.sum()

        for j in plan.inputs(tree, np.array([heap]))[0]:
            for c in range(grove.BINS - 1):
                left = at[codes[j, at] <= c]
                right = at[codes[j, at] > c]
                if len(left) and len(right):
                    gain = round((loss(at) - loss(left) - loss(right)) / counts.sum(), 9)
                    if gain > best[0]:
                        best = gain, (j, c, left, right)
    if best[1] is None:
        return counts / counts.sum()
    j, c, left, right = best[1]
    side = int(codes[j, row] > c)
    return plain_shares(plan, codes, y, n, weight, tree, 2 * heap + 1 + side, level + 1, (left, right)[side], row)


@pytest.mark.parametrize("subjects", [3, 40])
def test_forests_without_a_subject_equal_plain_ones(spark, subjects):
    panel = panel_of(spark, subjects, 150)
    rows = tuning._modelling_rows(panel, SPEC, NAMES)
    edges = boosting.split_values(rows, NAMES, grove.BINS)
    kept = grove._subject_rows(rows, "subject_id", NAMES, edges, 3)
    plan = grove.Plan(3, 3, 6, 4)
    data = panel.toPandas()
    label = data["label"].map(families.CLASSES.index).to_numpy()
    table = kept.toArrow().combine_chunks()
    own = grove._rows_of(plan, table.to_batches()[0], np.bincount(label, minlength=3))
    drawn = [own.drawn(t) for t in range(6)]
    assert 0.9 < np.mean(drawn) < 1.1 and len({d.tobytes() for d in drawn}) == 6
    want = {}
    for s, subject in enumerate(table.column("_s").to_pylist()):
        others = data[data["subject_id"] != subject]
        fill = boosting.codes_of(edges, others[list(NAMES)].median().to_numpy(float)[None, :])[0]
        codes = np.where(own.codes == grove.BINS, fill[:, None], own.codes)
        counts = np.bincount(label[data["subject_id"] != subject], minlength=3)
        weight = np.where(counts > 0, len(others) / (3 * np.maximum(counts, 1)), 1.0)
        used, said = own.sub != s, Counter()
        for row in np.flatnonzero(~used):
            votes = np.zeros(3)
            for t in range(6):
                at = np.flatnonzero(used & (drawn[t] > 0))
                votes += np.floor(plain_shares(plan, codes, own.y, drawn[t], weight, t, 0, 0, at, row) * grove.ONE)
            said[int(own.y[row]), int(votes.argmax())] += 1
        want[subject] = said
    assert said_by(spark, panel) == want


def test_large_nodes_are_summed_over_tasks(spark, monkeypatch):
    """Trees whose tops are grown level by level, and nodes looked at a few at once, say the same."""
    panel = panel_of(spark, 30).repartition(7)
    once = said_by(spark, panel)
    monkeypatch.setattr(grove, "LIMIT", 60)
    monkeypatch.setattr(grove, "PIECE", 50)
    monkeypatch.setattr(grove, "PAIRS", 3)
    levels, add = [], grove._add_level
    monkeypatch.setattr(grove, "_add_level", lambda *a: levels.append(add(*a)) or levels[-1])
    assert said_by(spark, panel) == once and sum(levels) >= 2
    monkeypatch.setattr(grove, "LIMIT", 0)  # down to the leaves
    assert said_by(spark, panel) == once


def test_scores_are_those_of_separate_forests(spark):
    """Which differ by their draws and candidate cuts."""
    panel = panel_of(spark, 4, 400).persist()
    family, params = families.FAMILIES["random_forest"], {"n_estimators": 60, "max_depth": 5}
    got = {r["subject_id"]: r for r in tuning.leave_one_subject_out(panel, SPEC, list(NAMES), family, params).collect()}
    assert len(got) == 4 and sum(r["n_rows"] for r in got.values()) == 400
    for subject, r in got.items():
        own = F.col("subject_id") == subject
        said = tuning.fit_predict(panel.where(~own), panel.where(own), SPEC, list(NAMES), family, params)
        assert r["macro_f1"] == pytest.approx(MacroF1Evaluator().evaluate(said), abs=0.1)


def test_forest_jobs_do_not_grow_with_subjects(spark):
    def jobs(subjects, name):
        spark.sparkContext.setJobGroup(name, name)
        found = tuning.leave_one_subject_out(panel_of(spark, subjects), SPEC, list(NAMES), families.FAMILIES["random_forest"], SETTING).count()
        number = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, number

    (few, jobs_few), (many, jobs_many) = jobs(3, "few_forests"), jobs(90, "many_forests")
    assert few == 3 and many > 60 and 0 < jobs_many <= jobs_few + 2


def test_odd_tables(spark):
    """No rows, one subject, a label that only one subject has, a feature without values."""
    family = families.FAMILIES["random_forest"]
    panel = panel_of(spark, 5, 60)
    assert tuning.leave_one_subject_out(panel.limit(0), SPEC, list(NAMES), family, SETTING).count() == 0
    assert tuning.leave_one_subject_out(panel.withColumn("subject_id", F.lit("s")), SPEC, list(NAMES), family, SETTING).first()["n_rows"] == 60
    alone = panel.withColumn("label", F.when(F.col("subject_id") == "s0", "High").otherwise("Low")).withColumn("c", F.lit(None).cast("double"))
    scores = {r["subject_id"]: r["macro_f1"] for r in tuning.leave_one_subject_out(alone, SPEC, list(NAMES), family, SETTING).collect()}
    assert len(scores) == 5 and scores["s0"] == 0.0


def test_draws_of_all_inputs_are_counted_at_once(monkeypatch):
    rng = np.random.default_rng(6)
    codes, y, n = rng.integers(0, grove.BINS + 1, (4, 50)), rng.integers(0, 3, 50), rng.integers(1, 4, 60)
    rows = grove.Rows(codes, y, *[np.zeros(50, np.int64)] * 2, *[np.zeros(1)] * 4)
    inputs, node, at, key = np.array([[0, 2], [1, 3], [0, 1]]), rng.integers(0, 3, 60), rng.integers(0, 50, 60), rng.integers(0, 5, 60)
    calls, bincount = [], np.bincount
    monkeypatch.setattr(grove.np, "bincount", lambda *args, **more: calls.append(1) or bincount(*args, **more))
    for by, keys in ((None, 3), (key, 5)):
        got = grove._histogram(grove.Plan(4, 3, 1, 5), rows, inputs, node, at, n, by, 0 if by is None else keys)
        want = np.zeros((keys, 2, grove.BINS + 1, 3))
        for i in range(60):
            for j in range(2):
                want[(node if by is None else by)[i], j, codes[inputs[node[i], j], at[i]], y[at[i]]] += n[i]
        assert got.shape == want.shape and (got == want).all()
    assert len(calls) == 2
