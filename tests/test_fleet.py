"""Fleets of models against the same models written out plainly."""

import warnings
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.functions import ordering
from panelloom.models import boosting, families, fleet, forest, kernel, knn, linear, network, together, tuning
from panelloom.models.boosting import Booster
from panelloom.models.evaluate import MacroF1Evaluator
from panelloom.models.fleet import NOBODY, Layout
from panelloom.models.network import Network
from panelloom.spec import PanelSpec

NAMES = ("a", "b", "c")


@pytest.fixture(scope="module")
def table(spark):
    """300 rows of three classes in five groups, few distinct values, some missing."""
    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, 300)
    x = np.round(rng.normal(size=(300, 3)) + np.stack([y, -y, y == 1], 1) * 0.8, 0).clip(-4, 4)
    x[rng.random((300, 3)) < 0.1] = np.nan
    g = rng.integers(0, 5, 300)
    rows = [(*[None if np.isnan(v) else float(v) for v in r], int(k), int(f)) for r, k, f in zip(x, y, g)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, label_index int, fold int").persist()
    medians = {o: np.nanmedian(x[g != o], axis=0) for o in (NOBODY, *range(5))}
    return frame, x, y, g, Layout(NAMES, 3, medians)


def plain_tree(x, r, depth, cuts):
    """Nested (feature, cut, left, right) or (sum r, sum h)."""
    best = (0.0, None)
    if depth:
        for j, values in enumerate(cuts):
            for v in values:
                left = x[:, j] <= v
                n, m = left.sum(), (~left).sum()
                if n and m:
                    gain = round(n * m / (n + m) * (r[left].mean() - r[~left].mean()) ** 2, 9)
                    if gain > best[0]:
                        best = (gain, (j, v, left))
    if best[1] is None:
        h = np.sum(np.abs(r) * (1 - np.abs(r)))
        return 2 / 3 * r.sum() / h if h > 1e-150 else 0.0
    j, v, left = best[1]
    return j, v, plain_tree(x[left], r[left], depth - 1, cuts), plain_tree(x[~left], r[~left], depth - 1, cuts)


def plain_value(tree, row):
    while isinstance(tree, tuple):
        j, v, left, right = tree
        tree = left if row[j] <= v else right
    return tree


def plain_booster(x, y, apply_to, depth, rate, rounds, cuts):
    shares = np.bincount(y, minlength=3) / len(y)
    scores, there = np.tile(np.log(shares), (len(x), 1)), np.tile(np.log(shares), (len(apply_to), 1))
    for _ in range(rounds):
        p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        trees = [plain_tree(x, (y == k) - p[:, k], depth, cuts) for k in range(3)]
        for k, tree in enumerate(trees):
            scores[:, k] += rate * np.array([plain_value(tree, r) for r in x])
            there[:, k] += rate * np.array([plain_value(tree, r) for r in apply_to])
    return there


@pytest.mark.parametrize("limit", [0, boosting.LIMIT])
def test_boosters_are_trained_apart_up_to_a_limit(table, monkeypatch, limit):
    """All rounds in one job, or with a pass per level of each; either way they equal plain ones."""
    frame, *_ = table
    monkeypatch.setattr(boosting, "LIMIT", limit)
    rounds, number = [], boosting._round
    monkeypatch.setattr(boosting, "_round", lambda *args: rounds.append(1) or number(*args))
    test_boosters_equal_plain_ones(table, monkeypatch, 64)
    assert len(rounds) == (0 if limit else 8)


@pytest.mark.parametrize("block_rows", [64, 4096])
def test_boosters_equal_plain_ones(table, monkeypatch, block_rows):
    """In several tasks and in one."""
    frame, x, y, g, layout = table
    monkeypatch.setattr(boosting, "KEEP", 3)
    monkeypatch.setattr(fleet, "BLOCK_ROWS", block_rows)
    cuts = boosting.split_values(frame, NAMES)
    assert [len(c) for c in cuts] == [len(np.unique(x[:, j][~np.isnan(x[:, j])])) - 1 for j in range(3)]
    blocks = fleet.pack(frame, NAMES, "label_index", "fold")
    assert (blocks.tasks == 1) == (block_rows == 4096)
    settings = [Booster(2, 0.3), Booster(3, 0.1), Booster(2, 0.3, 1), Booster(3, 0.3, 4)]
    ensemble, confusions = boosting.train(blocks, layout, cuts, settings, 8, (5, 8))
    for m, b in enumerate(settings):
        filled = layout.filled(x, b.out)
        for rounds in (5, 8):
            want = plain_booster(filled[g != b.out], y[g != b.out], filled, b.depth, b.rate, rounds, cuts)
            assert np.allclose(ensemble.scores(x, m, rounds), want, atol=1e-5)
            if b.out != NOBODY:
                held = g == b.out
                assert (confusions[rounds][m] == fleet.count_confusion(y[held], want[held].argmax(axis=1), 3)).all()
    assert np.allclose(ensemble.only(1, 5).scores(x, 0, 5), ensemble.scores(x, 1, 5))


def test_wide_features_are_cut_at_quantiles(spark):
    frame = spark.range(2000).select((F.col("id") % 997).cast("double").alias("a"), F.lit(1.5).alias("b"), F.lit(None).cast("double").alias("c"))
    a, b, c = boosting.split_values(frame, NAMES)
    assert len(a) == boosting.BINS - 1 and np.allclose(a, np.quantile(np.arange(2000) % 997, np.arange(1, 32) / 32))
    assert len(b) == 0 and len(c) == 0


def test_macro_f1_ignores_labels_that_never_occur():
    assert fleet.macro_f1(np.array([[2, 0, 0], [0, 0, 0], [0, 0, 0]])) == 1.0
    assert fleet.macro_f1(np.array([[2, 1, 0], [1, 0, 0], [0, 0, 0]])) == pytest.approx(1 / 3)
    assert fleet.macro_f1(np.zeros((3, 3))) == 0.0


def test_logistic_models_equal_separate_fits(table):
    """Against a plain Newton solver on each model's own rows."""
    frame, x, y, g, layout = table
    blocks = fleet.pack(frame, NAMES, "label_index", "fold")
    scaled = linear.scaling(blocks, layout, [NOBODY, 2])
    settings = [(0.1, NOBODY), (10.0, NOBODY), (1.0, 2)]
    for (c, out), got in zip(settings, linear.train(blocks, scaled, settings)):
        used = g != out
        filled = layout.filled(x[used], out)
        z = (filled - filled.mean(axis=0)) / filled.std(axis=0)
        assert np.allclose(scaled.scaled(x[used], out), z)
        labels, n = y[used], used.sum()
        weight = n / (3 * np.bincount(labels))[labels]

        def gradient(w):
            wrong = (linear.chances(w, z) - (labels[:, None] == np.arange(3))) * weight[:, None]
            return np.column_stack([wrong.T @ z / n + w[:, :-1] / (c * n), wrong.sum(axis=0) / n])

        # The objective is convex: where its gradient vanishes is the one solution.
        assert np.abs(gradient(got)).max() < 1e-6


def test_network_gradient_by_finite_differences():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(20, 4)), rng.integers(0, 3, 20)
    for hidden in ((5,), (6, 3)):
        flat = network.first_weights(4, hidden, 3, 1)
        _, gradient = network.loss_and_gradient(flat, hidden, 3, x, y)
        for i in range(0, len(flat), 3):
            ahead, behind = flat.copy(), flat.copy()
            ahead[i] += 1e-6
            behind[i] -= 1e-6
            slope = (network.loss_and_gradient(ahead, hidden, 3, x, y)[0] - network.loss_and_gradient(behind, hidden, 3, x, y)[0]) / 2e-6
            assert slope == pytest.approx(gradient[i], rel=1e-4, abs=1e-5)


def test_networks_learn_and_the_penalty_acts(table):
    frame, x, y, g, layout = table
    blocks = fleet.pack(frame, NAMES, "label_index", "fold")
    scaled = linear.scaling(blocks, layout, [NOBODY, 0])
    nets = [Network(h, a, o) for h in ((8,), (6, 4)) for a in (1e-4, 1e-3) for o in (NOBODY, 0)] + [Network((8,), 30.0)]
    flat = network.train(blocks, scaled, nets, most=60)
    again = network.train(blocks, scaled, nets, most=60)
    assert all(np.allclose(a, b) for a, b in zip(flat, again))  # drawn rows are the same in every run
    assert len({f.tobytes() for f in flat}) == len(nets)
    assert np.square(flat[-1]).sum() < 0.8 * np.square(flat[0]).sum()
    simple = linear.predictor(scaled, linear.train(blocks, scaled, [(1.0, NOBODY)])[0], NOBODY)
    assert (network.predictor(scaled, nets[0], flat[0])(x) == y).mean() > (simple(x) == y).mean() - 0.05


@pytest.fixture(scope="module")
def panel(spark, table):
    frame = table[0]
    days = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.monotonically_increasing_id(), F.lit(100_000)).cast("int"))
    named = F.get(F.array(*map(F.lit, families.CLASSES)), F.col("label_index"))
    return frame.select(F.concat(F.lit("s"), "fold").alias("subject_id"), days.alias("day"), named.alias("label"), *NAMES).persist()


SPEC = PanelSpec(groups={"g": NAMES})


def test_leaving_subjects_out_together_equals_fits_apart(spark, panel):
    family, params = families.FAMILIES["logistic_regression"], {"C": 1.0}
    got = {r["subject_id"]: (r["n_rows"], r["macro_f1"]) for r in tuning.leave_one_subject_out(panel, SPEC, list(NAMES), family, params).collect()}
    assert len(got) == 5
    for subject, (n, score) in got.items():
        own = F.col("subject_id") == subject
        said = tuning.fit_predict(panel.where(~own), panel.where(own), SPEC, list(NAMES), family, params)
        assert said.count() == n and MacroF1Evaluator().evaluate(said) == pytest.approx(score)


def test_jobs_do_not_grow_with_subjects(spark, panel):
    family, params = families.FAMILIES["logistic_regression"], {"C": 1.0, "max_iter": 3}

    def jobs(rows, name):
        spark.sparkContext.setJobGroup(name, name)
        found = tuning.leave_one_subject_out(rows, SPEC, list(NAMES), family, params).count()
        number = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, number

    few = panel.persist()
    # The same rows under four times as many subjects.
    many = panel.withColumn("subject_id", F.concat("subject_id", F.lit("_"), F.pmod(F.hash("day"), F.lit(4)).cast("string"))).persist()
    (n_few, jobs_few), (n_many, jobs_many) = jobs(few, "few"), jobs(many, "many")
    assert n_few == 5 and n_many == 20 and 0 < jobs_many <= jobs_few + 2


def test_nested_forests_and_neighbours(spark, panel):
    rows = families.with_balanced_weight(
        families.preprocessing(list(NAMES), True).fit(panel).transform(families.with_label_index(panel, "label"))
    ).withColumn("row_id", F.concat_ws("|", "subject_id", "day")).persist()
    grid = [{"n_estimators": n, "max_depth": d} for n in (10, 30) for d in (2, 5, None)]
    build = families.FAMILIES["random_forest"].build
    model = build(forest.largest(grid), 3, 300.0).fit(rows)
    got = forest.nested_scores(model, grid, rows, 3)
    whole = MacroF1Evaluator().evaluate(families.with_label_text(model.transform(rows)).withColumn("label", F.col("label")))
    assert got[5] == pytest.approx(whole)
    for score, setting in zip(got, grid):
        apart = MacroF1Evaluator().evaluate(families.with_label_text(build(setting, 3, 300.0).fit(rows).transform(rows)))
        assert score == pytest.approx(apart, abs=0.08)  # other random draws; the tolerance stated in the README
    grid = [{"n_neighbors": k} for k in (1, 3, 6)]
    for said, setting in zip(knn.nested_scores(grid, rows, rows), grid):
        apart = knn.NearestNeighbourClassifier(setting["n_neighbors"]).fit(rows).transform(rows)
        assert sorted(said.select("row_id", "prediction").collect()) == sorted(apart.select("row_id", "prediction").collect())


def test_tuning_takes_whole_grids(panel):
    grids = {"logistic_regression": {"C": [0.1, 1.0]}, "gradient_boosting": {"n_estimators": [2, 4], "learning_rate": [0.1], "max_depth": [2]},
             "mlp": {"hidden_layer_sizes": [[4]], "alpha": [0.0001, 0.001], "max_iter": [5]}, "knn": {"n_neighbors": [3, 5]}}
    chosen = {n: replace(families.FAMILIES[n], grid=g) for n, g in grids.items()}
    chosen["majority_baseline"] = families.FAMILIES["majority_baseline"]
    tuned = tuning.tune(panel, SPEC, list(NAMES), chosen, folds=3)
    rows = {r["model"]: r for r in tuned.tuning.collect()}
    assert {n: r["n_candidates"] for n, r in rows.items()} == {"logistic_regression": 2, "gradient_boosting": 2, "mlp": 2, "knn": 2, "majority_baseline": 1}
    assert rows["logistic_regression"]["cv_macro_f1"] > rows["mlp"]["cv_macro_f1"] - 0.5 > -0.5 and rows["majority_baseline"]["cv_macro_f1"] is None
    for model in tuned.models.values():
        assert tuning.predict(model, panel, SPEC, list(NAMES)).where("prediction IS NULL").count() == 0


def exact_machine(k, side, cost):
    """Dual of the hinge with an offset, always along the pair that violates most."""
    a, slope = np.zeros(len(side)), -np.ones(len(side))
    for _ in range(200_000):
        up = np.where(((side > 0) & (a < cost)) | ((side < 0) & (a > 0)), -side * slope, -np.inf)
        low = np.where(((side > 0) & (a > 0)) | ((side < 0) & (a < cost)), -side * slope, np.inf)
        i, j = up.argmax(), low.argmin()
        if up[i] - low[j] < 1e-5:
            break
        move = (up[i] - low[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        move = min(move, cost[i] - a[i] if side[i] > 0 else a[i], a[j] if side[j] > 0 else cost[j] - a[j])
        a[i] += side[i] * move
        a[j] -= side[j] * move
        slope += side * move * (k[:, i] - k[:, j])
    return a * side, (up[i] + low[j]) / 2


@pytest.mark.parametrize("block_rows, costs", [(128, [1.0]), (4096, [1.0, 10.0])])
def test_kernel_machines_equal_exact_ones(spark, monkeypatch, block_rows, costs):
    """500 rows; all of them as landmarks give the exact machines, a tenth nearly."""
    monkeypatch.setattr(fleet, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3))
    y = (np.hypot(x[:, 0], x[:, 1]) > 1.2).astype(int) + (x[:, 2] + 0.3 * rng.normal(size=500) > 0.5)
    g = rng.integers(0, 5, 500)
    frame = spark.createDataFrame([(*map(float, r), int(k), int(f)) for r, k, f in zip(x, y, g)], "a double, b double, c double, label_index int, _group int")
    layout = Layout(NAMES, 3, {o: np.median(x[g != o], axis=0) for o in (NOBODY, 1)})
    blocks = fleet.pack(frame, NAMES, "label_index", "_group")
    scaled = linear.scaling(blocks, layout, [NOBODY, 1])
    maps = {(w, o): m for w in (500, 50) for o, m in kernel.landmarks(frame, "_group", blocks, scaled, [NOBODY, 1], w).items()}
    machines = [kernel.Machine(c, w, o, *p) for c in costs for w in (500, 50, 0) for o in (NOBODY, 1) for p in kernel.pairs(3)]
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)  # all of them converge
        weights = kernel.train(blocks, scaled, maps, machines)
    assert kernel.kernel_error(maps[500, NOBODY], scaled.scaled(x, NOBODY)) < 1e-6
    assert kernel.kernel_error(maps[50, NOBODY], scaled.scaled(x, NOBODY)) < 0.02
    for at in range(0, len(machines), 3):
        m = machines[at]
        used, z = g != m.out, scaled.scaled(x, m.out)
        kept, n = y[used], used.sum()
        assert m.width == 0 or maps[m.width, m.out].gamma == pytest.approx(1 / 3)
        if m.width:  # landmarks are rows the model may see
            assert all((np.abs(z[used] - p).max(axis=1) < 1e-9).any() for p in maps[m.width, m.out].points)
        votes = np.zeros((500, 3))
        for a, b in kernel.pairs(3):
            own = used & ((y == a) | (y == b))
            k = (lambda u, v: kernel.gaussian(u, v, 1 / 3)) if m.width else (lambda u, v: u @ v.T)
            alpha, offset = exact_machine(k(z[own], z[own]), np.where(y[own] == a, 1.0, -1.0), m.cost * (n / (3 * np.bincount(kept)))[y[own]])
            votes[np.arange(500), np.where(k(z, z[own]) @ alpha + offset > 0, a, b)] += 1
        said = kernel.predictor(scaled, maps, machines[at : at + 3], weights[at : at + 3])(x)
        agree = (said == votes.argmax(axis=1)).mean()
        assert agree >= (0.95 if m.width == 50 else 0.99)


def test_kernel_machines_of_few_labels(spark):
    """A label without rows gets no votes; all rows alike leave no kernel to speak of."""
    frame = spark.createDataFrame([(1.0, None, 2.0, 1, i % 2) for i in range(6)], "a double, b double, c double, label_index int, _group int")
    layout = Layout(NAMES, 3, {o: np.zeros(3) for o in (NOBODY, 0)})
    blocks = fleet.pack(frame, NAMES, "label_index", "_group")
    scaled = linear.scaling(blocks, layout, [NOBODY, 0])
    maps = {(4, o): m for o, m in kernel.landmarks(frame, "_group", blocks, scaled, [NOBODY, 0], 4).items()}
    for width in (0, 4):
        machines = [kernel.Machine(1.0, width, 0, *p) for p in kernel.pairs(3)]
        weights = kernel.train(blocks, scaled, maps, machines)
        assert (kernel.predictor(scaled, maps, machines, weights)(np.array([[1.0, np.nan, 2.0], [9.0, 9.0, 9.0]])) == 1).all()


def test_medians_without_a_group_come_from_the_middle(spark, monkeypatch):
    """Equal to medians on copies of the rows, as are those from counts, for ties, gaps and groups of one or most rows."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        a, b = float(rng.normal()), float(rng.integers(0, 3))
        rows.append((int(min(i % 23, 20)) if i > 150 else 20, None if i % 5 == 0 else a, None if i % 7 == 0 else b, -1e9 * a if i == 399 else None, 0.0))
    frame = spark.createDataFrame(rows, "g int, a double, b double, c double, label_index double")
    shared = together.Shared(frame, ["a", "b", "c"], 3, "g", list(range(21)))
    lists = F.array(*[F.lit(o) for o in (NOBODY, *range(21))])
    copies = frame.select("a", "b", "c", F.explode(F.filter(lists, lambda o: o != F.col("g"))).alias("_out"))
    want = {o: np.zeros(3) for o in (NOBODY, *range(21))}
    for r in ordering.quantiles(copies, ["a", "b", "c"], [0.5], ["_out"]).collect():
        want[r["_out"]]["abc".index(r["feature"])] = r["quantile"]
    counted = shared._counted_medians()
    assert sorted(counted) == sorted(want) and all((counted[o] == want[o]).all() for o in want)
    monkeypatch.setattr(together.Shared, "_counted_medians", lambda self: pytest.fail("not from the middle"))
    got = shared.layout.medians
    assert sorted(got) == sorted(want) and all((got[o] == want[o]).all() for o in want)


def test_many_subjects_are_left_out_in_one_fleet(spark, monkeypatch):
    """Rows are packed and medians found once, not once per 256 subjects."""
    rows = [(f"s{i % 300}", f"d{i}", ("Low", "Medium", "High")[i * i % 3], float(i % 7), float(i % 11)) for i in range(900)]
    panel = spark.createDataFrame(rows, "subject_id string, day string, label string, a double, b double")
    packed, pack = [], fleet.pack
    monkeypatch.setattr(fleet, "pack", lambda *args: packed.append(1) or pack(*args))
    family = families.FAMILIES["logistic_regression"]
    scores = tuning.leave_one_subject_out(panel, SPEC, ["a", "b"], family, {"C": 1.0, "max_iter": 2})
    assert scores.count() == 300 and len(packed) == 1


def test_ends_estimated_wrongly_are_noticed(spark, monkeypatch):
    frame = spark.createDataFrame([(i % 50, float(i), 0.0) for i in range(500)], "g int, a double, label_index double")
    shared = together.Shared(frame, ["a"], 3, "g", list(range(50)))
    assert shared._near_medians() is not None
    for wrong in (0.0, 300.0):
        monkeypatch.setattr(F, "percentile_approx", lambda *_: F.array(F.lit(wrong), F.lit(wrong + 9)))
        assert shared._near_medians() is None


def test_models_that_leave_a_group_out_take_few_steps(table, monkeypatch):
    """They start from the model of all rows."""
    frame, *_, layout = table
    blocks = fleet.pack(frame, NAMES, "label_index", "fold")
    scaled = linear.scaling(blocks, layout, [NOBODY, 2])
    passes, reduce = [], fleet.reduce
    monkeypatch.setattr(fleet, "reduce", lambda *a, **k: passes.append(1) or reduce(*a, **k))
    linear.train(blocks, scaled, [(1.0, NOBODY)])
    alone = len(passes)
    linear.train(blocks, scaled, [(1.0, NOBODY), (1.0, 2)])
    assert len(passes) - 2 * alone < alone - 1


def test_rows_alike_are_one_with_a_count(spark, table, monkeypatch):
    """Copies of a table cost no more blocks and give the models of the copied rows."""
    frame, x, y, g, layout = table
    copies = frame.crossJoin(spark.range(40)).drop("id")
    monkeypatch.setattr(fleet, "BLOCK_ROWS", 64)
    once, often = (fleet.pack(f, NAMES, "label_index", "fold") for f in (frame, copies))
    assert often.tasks == once.tasks and sum(fleet.class_counts(often, 3, 3)[NOBODY]) == 12_000
    cuts = boosting.split_values(frame, NAMES)
    settings = [Booster(2, 0.3), Booster(2, 0.3, 1)]
    got = [boosting.train(b, layout, cuts, settings, 3, (3,)) for b in (once, often)]
    assert np.allclose(got[0][0].scores(x, 1, 3), got[1][0].scores(x, 1, 3), atol=1e-5)
    assert (40 * got[0][1][3][1] == got[1][1][3][1]).all()
    scaled = [linear.scaling(b, layout, [NOBODY]) for b in (once, often)]
    assert np.allclose(scaled[0].std[NOBODY], scaled[1].std[NOBODY])
    # The driver adds few numbers, a shuffle adds many: the sums are the same.
    sums = [fleet.reduce(often, 3, lambda b: iter([(int(b["y"][0]), b["n"] @ np.nan_to_num(b["x"]))]), None, n) for n in (9, None)]
    assert sums[0].keys() == sums[1].keys() and all(np.allclose(sums[0][k], sums[1][k]) for k in sums[0])
