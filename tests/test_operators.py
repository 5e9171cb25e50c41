"""Hand-made edge cases."""

import datetime as dt
import itertools
import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.functions import ordering, scalars
from panelloom.models import evaluate, knn, robustness
from panelloom.operators import clean, compare, coverage, daily, prep, profile, split, temporal, validate
from panelloom.sources.readings import Measure
from panelloom.spec import EVENTS, PanelSpec

KEY = ["subject_id", "day"]
D = dt.date(2024, 1, 1)


def day(n):
    return D + dt.timedelta(days=n)


def values(frame, *columns):
    return sorted([tuple(r[c] for c in columns) for r in frame.collect()], key=repr)


def test_unreadable_times_are_null(spark):
    frame = spark.createDataFrame([("86400",), ("x",), (None,)], "t string")
    assert [r[0] for r in frame.select(scalars.unix_day(F.col("t"))).collect()] == [dt.date(1970, 1, 2), None, None]
    frame = spark.createDataFrame(
        [("2024-01-02T23:30:00Z",), ("2024-01-02 01:00:00",), ("2024-01-02",), ("2024-01-01T23:30:00-02:00",), ("?",)],
        "t string",
    )
    found = [r[0] for r in frame.select(scalars.lenient_day(F.col("t"))).collect()]
    assert found == [day(1)] * 4 + [None]


def test_bands_apply_to_averages(spark):
    frame = spark.createDataFrame([(17.0,), (17.5,), (38.0,), (38.1,), (None,)], "x double")
    assert [r[0] for r in frame.select(scalars.band(F.col("x"))).collect()] == ["Low", "Medium", "Medium", "High", None]


def test_small_scalars(spark):
    frame = spark.createDataFrame([(1.0, 0.0, [2.0, 1.5])], "a double, b double, v array<double>")
    row = frame.select(
        scalars.percent(F.col("a"), F.col("b")).alias("p"),
        scalars.join_values(F.array_sort("v")).alias("t"),
        scalars.half_even(F.lit(2.5), 0).alias("h"),
        scalars.number(F.lit("x")).alias("n"),
    ).first()
    assert (row.p, row.t, row.h, row.n) == (0.0, "1.5; 2.0", 2.0, None)


READINGS = [
    ("a", D, "steps", None, None, None),
    ("a", D, "steps", None, None, None),
    ("a", D, "level", None, "odd", None),
    ("a", day(1), "level", None, None, None),
    ("a", D, "o2", 97.0, None, None),
    ("a", D, "flag", None, None, None),
    ("b", D, "flag", None, None, None),
    ("b", D, "flag", None, None, True),
    ("b", None, "steps", 5.0, None, None),
]


def test_daily_aggregates(spark):
    frame = spark.createDataFrame(READINGS, "subject_id string, day date, modality string, v double, l string, f boolean")
    measures = [
        Measure("total", "steps", "v", "sum"),
        Measure("low", "level", "l", "level", "SEDENTARY"),
        Measure("mean", "o2", "v", "mean"),
        Measure("std", "o2", "v", "std"),
        Measure("any", "flag", "f", "any"),
    ]
    one = lambda m: daily.daily_modality(frame, KEY, measures, m)
    assert values(one("steps"), "subject_id", "total") == [("a", 0.0)]
    # an unknown level keeps its day at zero, a null level does not create one
    assert values(one("level"), "subject_id", "day", "low") == [("a", D, 0.0)]
    assert values(one("o2"), "mean", "std") == [(97.0, None)]
    assert values(one("flag"), "subject_id", "any") == [("a", None), ("b", True)]
    # the joint grouping says the same, with nulls where a kind is absent
    joint = {(r.subject_id, r.day): r for r in daily.daily_table(frame, KEY, measures).collect()}
    assert set(joint) == {("a", D), ("b", D)}
    assert (joint["a", D].total, joint["a", D].low, joint["a", D].std) == (0.0, 0.0, None)
    assert (joint["b", D].total, joint["b", D].low, joint["b", D]["any"]) == (None, None, True)


SMALL = PanelSpec(groups={"g": ("x",)})
ROW = "subject_id string, day date, score double, secondary double, label string, x double, device_flag boolean"


def test_duplicates_resolved_and_profiled(spark):
    rows = spark.createDataFrame(
        [
            ("a", D, 17.0, 1.0, "Low", 4.0, None),
            ("a", D, 18.0, 1.0, "Medium", 4.0, True),
            ("b", D, 5.0, None, "Low", None, None),
            ("c", D, 9.0, 2.0, "Low", None, False),
            ("c", D, 9.0, 2.0, "Low", None, None),
        ],
        ROW,
    )
    resolved = {r.subject_id: r for r in clean.resolve_duplicates(rows, SMALL).collect()}
    assert (resolved["a"].score, resolved["a"].label, resolved["a"].device_flag) == (17.5, "Medium", True)
    assert resolved["b"].device_flag is None and resolved["c"].device_flag is False
    found = {r.subject_id: r for r in clean.duplicate_conflicts(rows, SMALL).collect()}
    assert set(found) == {"a", "c"}
    assert found["a"].value_conflict and found["a"].label_conflict and found["a"].label_values == "Low; Medium"
    assert found["a"].score_values == "17.0; 18.0" and not found["c"].value_conflict
    # a key with very many rows lists all of them
    many = rows.unionByName(rows.where("subject_id = 'b'").select(*[c for c in rows.columns if c != "score"])
                            .crossJoin(spark.range(5000).selectExpr("CAST(id % 7 AS DOUBLE) AS score")))
    long = {r.subject_id: r for r in clean.duplicate_conflicts(many, SMALL).collect()}["b"]
    assert long.n_rows == 5001 and len(long.score_values.split("; ")) == 5001 and long.secondary_values == ""
    assert long.score_values.startswith("0.0; 0.0") and long.score_values.endswith("6.0; 6.0")
    assert values(clean.repeated_values(rows, KEY, "score"), "subject_id", "value", "n") == [
        ("a", 17.0, 1), ("a", 18.0, 1), ("c", 9.0, 2)]
    summary = clean.duplicate_summary(rows, SMALL).first()
    assert (summary.rows_of_repeated_keys, summary.surplus_rows, summary.repeated_keys) == (4, 2, 2)
    assert (summary.keys_with_score_conflict, summary.keys_with_label_conflict) == (1, 1)


def make_panel(spark, seed=1, subjects=4, empty=0.4):
    rng = random.Random(seed)
    rows = []
    for s in range(subjects):
        t = 0
        for _ in range(rng.randint(1, 25)):
            t += rng.choice([1, 1, 2, 10])
            rows.append((f"s{s}", day(t), float(rng.randint(0, 60)), None if rng.random() < empty else rng.random() * 9))
    return rows, spark.createDataFrame(rows, "subject_id string, day date, score double, x double")


@pytest.mark.parametrize("block_days", [None, 1, 4, 30])
def test_past_features_against_loops(spark, block_days):
    rows, panel = make_panel(spark)
    got = temporal.add_past_features(panel, SMALL, block_days=block_days)
    table = {(r.subject_id, r.day): r for r in got.collect()}
    assert len(table) == len(rows)
    mean = lambda v: statistics.fmean([z for z in v if z is not None]) if any(z is not None for z in v) else None
    near = lambda a, b: (a is None and b is None) or a == pytest.approx(b)
    for _, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        seen = []
        for subject, when, _, x in group:
            r = table[subject, when]
            assert near(r.x_lag1, seen[-1] if seen else None)
            assert near(r.x_rolling3_mean, mean(seen[-3:])) and near(r.x_rolling7_mean, mean(seen[-7:]))
            past = mean(seen)
            assert near(r.x_deviation_from_past_mean, None if past is None or x is None else x - past)
            seen.append(x)


def test_past_features_do_not_leak(spark):
    _, panel = make_panel(spark)
    good = temporal.add_past_features(panel, SMALL)
    assert temporal.past_only_violations(good, SMALL, ["x"]).first()[0] == 0
    bad = good.withColumn("x_lag1", F.col("x"))
    assert temporal.past_only_violations(bad, SMALL, ["x"]).first()[0] > 0


def test_past_only_checks_reach_every_feature(spark):
    from __spark_entry__ import queries
    from panelloom.plans.catalog.registry import FEATURES
    from tests.check_queries import compare, connect

    folder = "/root/testdata/sf0.001"
    seen = {"intact": {}, "leaking": {}}
    for name in [n for n in queries() if n.startswith("past_only_check")]:
        assert compare(spark, connect(folder), name, folder)[2] == "ok"
        for r in queries()[name](spark, folder).collect():
            seen[r["subject_table"]][r["feature"]] = r["violations"]
    wanted = {f"{f}{k}" for f in FEATURES for k in temporal.ALL_KINDS}
    assert set(seen["intact"]) == set(seen["leaking"]) == wanted
    assert not any(seen["intact"].values())


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_and_ranks_against_brute_force(spark, seed):
    rng = random.Random(seed)
    # a third of all rows share one value; signs, zeros and magnitudes mix
    data = [("g", 7.25)] * 100 + [("g", rng.choice([0.0, 1.0, -1.0, 2.0, rng.gauss(0, 10 ** rng.randint(-3, 6))]))
                                 for _ in range(200)] + [("h", 3.0), ("k", 8.0), ("k", 7.999999999999999)]
    frame = spark.createDataFrame(data, "g string, v double")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.share): r.quantile for r in ordering.quantiles(frame, ["v"], shares, ["g"]).collect()}
    for g in ("g", "h", "k"):
        column = sorted(v for h, v in data if h == g)
        for s in shares:
            p = s * (len(column) - 1)
            lo, hi = column[int(p)], column[min(int(p) + 1, len(column) - 1)]
            assert got[g, s] == pytest.approx(lo + (p - int(p)) * (hi - lo), abs=1e-12)
    ranks = ordering.average_ranks(frame.groupBy("g", "v").agg(F.count("*").alias("n")), ["g"], "v")
    for r in ranks.collect():
        column = sorted(v for h, v in data if h == r.g)
        assert r.avg_rank == column.index(r.v) + (column.count(r.v) + 1) / 2


def test_hash_and_sorted_ordinals(spark):
    frame = spark.range(500).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("c"))
    numbered = ordering.with_hash_ordinal(frame, ["id"], 7, within=["c"]).collect()
    for c in range(3):
        assert sorted(r.ordinal for r in numbered if r.c == c) == list(range(sum(r.c == c for r in numbered)))
    ordered = ordering.with_sorted_ordinal(frame, ["id"]).orderBy("ordinal").collect()
    assert [r.id for r in ordered] == sorted(str(i) for i in range(500))
    assert [r.ordinal for r in ordered] == list(range(500))


def test_balanced_folds_follow_the_greedy_rule():
    rng = random.Random(3)
    for _ in range(50):
        folds = rng.randint(2, 6)
        sizes = {rng.randint(1, 40): rng.randint(1, 12) for _ in range(rng.randint(1, 8))}
        loads, expected = [0] * folds, {}
        for size in sorted(sizes, reverse=True):
            expected[size] = []
            for _ in range(sizes[size]):
                lightest = loads.index(min(loads))
                loads[lightest] += size
                expected[size].append(lightest)
        for size, first, cycle in split._greedy_plan(list(sizes.items()), folds):
            got = [first[i] if i < len(first) else cycle[(i - len(first)) % folds] for i in range(sizes[size])]
            assert got == expected[size]


def test_split_checks(spark):
    whole = spark.createDataFrame([("a", "train"), ("a", "train"), ("b", "test")], "subject_id string, split string")
    split.require_whole_subjects(whole, EVENTS)
    torn = whole.union(spark.createDataFrame([("a", "test")], whole.schema))
    with pytest.raises(ValueError):
        split.require_whole_subjects(torn, EVENTS)
    with pytest.raises(ValueError):
        split.split_parts(whole.where("split = 'train'"))


def test_scaling_and_imputation_learn_from_train_only(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, c double")
    test = spark.createDataFrame([(None, 6.0), (100.0, 5.0)], "x double, c double")
    assert values(prep.median_impute(test, train, ["x"]), "x") == [(100.0,), (2.0,)]
    scaled = prep.standard_scale(train, train, ["x", "c"])
    assert values(scaled, "x", "c") == [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]
    fitted = prep.MedianImputer(inputCols=["x"]).fit(train)
    assert fitted.values == {"x": 2.0}


def test_guards(spark):
    frame = spark.createDataFrame([(1.0, None)], "x double, y double")
    with pytest.raises(ValueError, match="lacks columns"):
        validate.require_columns(frame, ["z"])
    with pytest.raises(ValueError, match="nulls"):
        validate.require_no_nulls(frame, ["x", "y"])
    for column in ("score", "score_lag1", "subject_id"):
        with pytest.raises(ValueError):
            validate.require_leak_free(["x", column], SMALL)


def test_macro_f1_uses_labels_of_either_side(spark):
    rows = [("Low", "Low"), ("Low", "High"), ("Low", "Low")]
    frame = spark.createDataFrame(rows, "label string, prediction string")
    got = evaluate.evaluate(frame).first()
    assert got.macro_f1 == pytest.approx((0.8 + 0) / 2) and got.medium_support == 0
    perfect = spark.createDataFrame([("Low", "Low")], "label string, prediction string")
    assert evaluate.MacroF1Evaluator().evaluate(perfect) == 1.0


# A published three-class confusion matrix and its scores.
MATRIX = {"Low": (178, 85, 123), "Medium": (81, 61, 125), "High": (96, 54, 98)}
SCORES = {
    "accuracy": 0.37402885682574916,
    "macro_precision": 0.36321514830795953,
    "macro_recall": 0.36158853539043107,
    "macro_f1": 0.35721338294688154,
    "low_f1": 0.48043184885290147,
    "medium_f1": 0.26124197002141325,
    "high_f1": 0.32996632996632996,
}


def test_published_confusion_matrix_gives_published_scores(spark):
    rows = [(a, p) for a, counts in MATRIX.items() for p, n in zip(MATRIX, counts) for _ in range(n)]
    frame = spark.createDataFrame(rows, "label string, prediction string")
    got = evaluate.evaluate(frame).first().asDict()
    assert {k: got[k] for k in SCORES} == pytest.approx(SCORES)
    assert (got["low_support"], got["medium_support"], got["high_support"]) == (386, 267, 248)
    matrix = {r.actual: (r.predicted_low, r.predicted_medium, r.predicted_high)
              for r in evaluate.confusion_matrix(frame).collect()}
    assert matrix == MATRIX
    assert evaluate.hardest_class(evaluate.per_class(frame)).first().label == "Medium"


# Published split summary, (subjects, rows, low, medium, high),
# and the held-out subjects (rows, low, medium, high) it sums up.
HELD_OUT = [(39, 8, 22, 9), (71, 32, 14, 25), (117, 71, 35, 11), (108, 49, 35, 24), (115, 57, 29, 29),
            (116, 2, 10, 104), (115, 28, 56, 31), (118, 103, 8, 7), (102, 36, 58, 8)]


def test_published_split_summary(spark):
    rows = [
        (f"s{i}", label, "test")
        for i, (_, *counts) in enumerate(HELD_OUT)
        for label, n in zip(("Low", "Medium", "High"), counts)
        for _ in range(n)
    ]
    frame = spark.createDataFrame(rows, "subject_id string, label string, split string")
    got = profile.split_summary(frame, EVENTS).first()
    assert tuple(got) == ("test", 9, 901, 386, 267, 248)
    assert split.subject_split(frame, EVENTS).where("split = 'test'").count() == 3


def test_published_best_per_group(spark):
    rows = [
        ("sleep_only", "random_forest", 0.3907340203736524), ("sleep_only", "svm", 0.36991361424517577),
        ("activity_only", "gradient_boosting", 0.3564357692827411), ("activity_only", "svm", 0.3432635501720514),
        ("hrv_spo2_only", "random_forest", 0.39322283919634754), ("hrv_spo2_only", "mlp", 0.38852843709655477),
        ("all_wearable", "mlp", 0.35721338294688154), ("all_wearable", "svm", 0.35591560797114913),
    ]
    frame = spark.createDataFrame(rows, "condition string, model string, macro_f1 double")
    best = {r.condition: r.model for r in compare.best_per_group(frame, ["condition"], "macro_f1", ["model"]).collect()}
    assert best == {"sleep_only": "random_forest", "activity_only": "gradient_boosting",
                    "hrv_spo2_only": "random_forest", "all_wearable": "mlp"}


def test_histograms(spark):
    frame = spark.createDataFrame([(0.0,), (4.9,), (5.0,), (100.0,)], "x double")
    fixed = profile.histogram_fixed(frame, "x")
    assert fixed.count() == 20 and fixed.agg(F.sum("n")).first()[0] == 3
    equal = profile.histogram_equal_width(frame, ["x"], 4).orderBy("bin").collect()
    assert [r.n for r in equal] == [3, 0, 0, 1]


def test_table_compare_counts_multisets(spark):
    schema = "subject_id string, day date, v double"
    old = spark.createDataFrame([("a", D, 1.0), ("a", D, 2.0), ("b", D, 1.0), ("c", D, None)], schema)
    new = spark.createDataFrame([("a", D, 2.0), ("a", D, 1.0), ("b", D, 1.0), ("b", D, 1.0), ("d", D, 1.0)], schema)
    got = compare.table_compare(old, new, KEY, ["v"]).first()
    assert (got.common_keys, got.old_only_keys, got.new_only_keys) == (2, 1, 1)
    assert (got.different_row_counts, got.different_v) == (1, 1)


def test_neighbours_against_brute_force(spark):
    rng = random.Random(5)
    point = lambda: [rng.choice([0.0, rng.gauss(0, 1)]) for _ in range(3)]
    train = [(i, point(), "x") for i in range(300)] + [(300 + i, [1.0, 1.0, 1.0], "y") for i in range(150)]
    test = [(1000 + i, point()) for i in range(60)] + [(2000 + i, [1.0, 1.0, 1.0]) for i in range(30)]
    left = spark.createDataFrame(train, "id bigint, v array<double>, label string")
    right = spark.createDataFrame(test, "id bigint, v array<double>")
    got = {}
    for r in knn.nearest_neighbours(left, right, 4, "id", "id", "v", "label", pivots=12, block_rows=8).collect():
        got.setdefault(r.id, {})[r.place] = r.neighbour
    for i, v in test:
        order = sorted((sum((a - b) ** 2 for a, b in zip(v, w)) ** 0.5, j) for j, w, _ in train)
        assert [got[i][p] for p in range(1, 5)] == [j for _, j in order[:4]]


def test_bootstrap_keeps_the_number_of_subjects(spark):
    rows = [(f"s{i}", "Low", "Low" if i % 2 else "High") for i in range(8) for _ in range(i + 1)]
    frame = spark.createDataFrame(rows, "subject_id string, label string, prediction string")
    draws = robustness.bootstrap_draws(frame, "subject_id", draws=50).collect()
    assert len(draws) == 50 and len({r.macro_f1 for r in draws}) > 5
    both = compare.union_conditions({"p": frame, "q": frame}, "analysis")
    paired = robustness.bootstrap_draws(both, "subject_id", ["analysis"], draws=20)
    assert paired.groupBy("draw").agg(F.count_distinct(F.round("macro_f1", 12)).alias("n")).where("n > 1").count() == 0


def test_hot_key_is_counted_whole(spark):
    """One key holds a third of the rows; nothing is dropped or cut."""
    rows = [("hot", D, float(i % 7)) for i in range(300)] + [(f"s{i}", day(i % 5), 1.0) for i in range(600)]
    frame = spark.createDataFrame(rows, "subject_id string, day date, score double").withColumn(
        "event_id", F.monotonically_increasing_id()
    )
    marked = clean.mark_duplicates(frame, KEY, "event_id")
    assert marked.count() == 900 and marked.where("is_surplus").count() == 299
    assert coverage.key_flags(frame, frame, KEY).count() == 601


def test_narrow_columns_do_not_meet_in_one_window(spark):
    """A hundred thousand values in a range of a ten-thousandth, all in one cell."""
    from panelloom.functions import ordering

    frame = spark.range(100_000).selectExpr("1000 + CAST(id AS DOUBLE) / 1000000 AS x")
    cells = frame.select(ordering.cell_of(F.col("x")).alias("cell"), ordering.inner_of(F.col("x")).alias("inner"))
    assert cells.groupBy("cell").count().agg(F.max("count")).first()[0] > 50_000
    assert cells.groupBy("cell", "inner").count().agg(F.max("count")).first()[0] < 100
    got = {r["share"]: r["quantile"] for r in ordering.quantiles(frame, ["x"], [0.25, 0.5, 1.0]).collect()}
    assert got[0.5] == pytest.approx(1000.0499995, abs=1e-9) and got[1.0] == 1000 + 99_999 / 1000000
    ranks = ordering.average_ranks(frame.selectExpr("x", "1L AS n", "'f' AS feature"), ["feature"], "x")
    assert ranks.where("abs(avg_rank - (round((x - 1000) * 1000000) + 1)) > 0.01").count() == 0


def test_ranks_tie_where_values_tie_on_paper(spark):
    """Sums in another order differ in their last bits, which must not split a tie."""
    rows = [(0.1 + 0.2, 1.0), (0.3, 2.0), (0.3, 0.6 + 0.3), (0.7, 0.9), (1.5, 2.5)]
    frame = spark.createDataFrame(rows, "x double, y double")
    paper = spark.createDataFrame([(round(x, 9), round(y, 9)) for x, y in rows], "x double, y double")
    rho = lambda f, **kw: profile.spearman(f, "y", ["x"], **kw).first()["rho"]
    assert rho(frame) == rho(paper, digits=None) != rho(frame, digits=None)


@pytest.mark.parametrize("bits", [20, 2])
def test_rank_correlation_ranks_the_target_once(spark, monkeypatch, bits):
    """One row per distinct target, whatever the features and copies; gaps differ by feature; crowded cells are divided."""
    rng = np.random.default_rng(6)
    y = np.round(rng.normal(size=300), 2)
    x = np.stack([y + rng.normal(size=300), rng.integers(0, 3, 300), -y + rng.normal(size=300), np.full(300, np.nan)], 1)
    x[rng.random(300) < 0.4, 2] = np.nan
    x[:, 0] = np.where(rng.random(300) < 0.3, 1.5, np.round(x[:, 0], 3))
    table = pd.DataFrame(x, columns=list("abcd")).assign(y=y)
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in table.to_numpy()] + [(1.0, 1.0, 1.0, 1.0, None)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double, y double").crossJoin(spark.range(20)).drop("id")
    sizes, ranked = [], ordering.ranked
    monkeypatch.setattr(ordering, "ranked", lambda h, *a: sizes.append(h.count()) or ranked(h, *a))
    monkeypatch.setattr(ordering, "INNER_BITS", bits)
    got = {r["feature"]: (r["pairs"], r["rho"]) for r in profile.spearman(frame, "y", list("abcd")).collect()}
    assert sizes == [table["y"].nunique(), sum(table[f].nunique() for f in "abcd")]
    assert sorted(got) == ["a", "b", "c"]
    for f, (pairs, rho) in got.items():
        both = table[[f, "y"]].dropna()
        assert pairs == 20 * len(both) and rho == pytest.approx(both[f].rank().corr(both["y"].rank()), abs=1e-12)


def test_equal_vectors_are_searched_once(spark, monkeypatch):
    """Only the first k of equal training rows, and one of equal queries, are compared; all queries get their rows."""
    left = spark.createDataFrame([(i, [0.0, 1.0] if i < 500 else [float(i), 0.0], i % 3) for i in range(520)], "id int, v array<double>, label int")
    right = spark.createDataFrame([(1000 + i, [0.0, 1.0] if i < 300 else [float(500 + i - 300), 0.1]) for i in range(310)], "id int, v array<double>")
    seen, compared = [], knn._compared
    monkeypatch.setattr(knn, "_compared", lambda q, t, *rest: seen.append((q.count(), t.count())) or compared(q, t, *rest))
    got = {}
    for r in knn.nearest_neighbours(left, right, 4, "id", "id", "v", "label").collect():
        got.setdefault(r["id"], []).append((r["place"], r["neighbour"], r["distance"], r["label"]))
    assert seen[0] == (11, 24)
    rows = [(r["id"], r["v"], r["label"]) for r in left.collect()]
    for q in right.collect():
        near = sorted((math.dist(v, q["v"]), i, label) for i, v, label in rows)[:4]
        assert [(n, label) for _, n, _, label in sorted(got[q["id"]])] == [(i, label) for _, i, label in near]
        assert [d for _, _, d, _ in sorted(got[q["id"]])] == pytest.approx([d for d, _, _ in near])


def test_products_only_rule_out_what_is_far():
    """Same neighbours and the same bits as by direct differences, near ties and far origins included."""
    rng = np.random.default_rng(1)
    for shift in (0.0, 1e6):
        centres = np.repeat(rng.normal(size=(150, 5)), 3, axis=0) + shift
        centres[::3] += 1e-13
        points = np.concatenate([centres[:40], rng.normal(size=(60, 5)) + shift])
        d = knn._distances(points, centres)
        rows, columns = knn._nearest_columns(d, 4)
        found = knn._nearest(points, centres, 4)
        assert (found[0] == rows).all() and (found[1] == columns).all() and (found[2] == d[rows, columns]).all()


def test_draws_are_dealt_out_before_they_are_drawn(spark):
    """Many draws of few subjects are not made in one task."""
    frame = spark.createDataFrame([(str(i), "Low", "High") for i in range(20)], "s string, label string, prediction string")
    plan = robustness.bootstrap_draws(frame, "s", draws=50)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("summary", [False, True])
def test_bootstrap_picks_are_not_broadcast(spark, summary):
    """Their number is subjects times draws, which Spark's estimate leaves out."""
    frame = spark.createDataFrame([(str(i), "Low", "Low") for i in range(20)], "s string, label string, prediction string")
    frame = robustness.bootstrap_draws(frame, "s", draws=50)
    if summary:
        frame = robustness.bootstrap_summary(frame, spark.createDataFrame([(1.0,)], "macro_f1 double"))
    assert len(frame.collect()) == (1 if summary else 50)
    lines = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [line for line in lines if "_pick" in line and "Join" in line]
    assert joins and all("BuildRight" in line for line in joins)
