"""Grid search over folds of whole subjects, model and feature-set comparison.

Candidates share their work: logistic regressions, networks and boosters of all
settings and folds are trained in the same passes, a forest and a neighbour
search of the largest setting score the settings they hold. What is left are
ordinary fits submitted from a few driver threads.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from typing import Any

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.models import families, fleet, forest, knn, together
from panelloom.models.evaluate import MacroF1Evaluator, confusion_matrix, confusion_percent, evaluate
from panelloom.models.families import Family
from panelloom.operators import split as splitting
from panelloom.operators.compare import best_per_group, union_conditions, with_tuning
from panelloom.session import cut_lineage, ensure_checkpoint_dir
from panelloom.spec import LABELS, SEED, PanelSpec

PARALLEL_FITS = 8
FLEET = 2048  # models that leave one subject out, trained together
FLEET_NUMBERS = 4_000_000  # that a pass of such models moves a task, at most
RESULT_SCHEMA = "model string, cv_macro_f1 double, best_params string, n_candidates int"


@dataclass
class Tuned:
    """Refitted models by family and the tuning table."""

    models: dict[str, Model]
    tuning: DataFrame


def _modelling_rows(panel: DataFrame, spec: PanelSpec, features: Sequence[str]) -> DataFrame:
    """Key, label and features only, with a row id for joins back."""
    rows = families.with_label_index(panel.select(*spec.key, spec.label, *features), spec.label)
    return rows.withColumn("row_id", F.concat_ws("|", *spec.key)).withColumnRenamed(spec.label, "label")


def _score(model: Model, ready: DataFrame) -> float:
    predicted = families.with_label_text(model.transform(ready))
    return MacroF1Evaluator().evaluate(predicted)


def _parallel(spark: SparkSession, jobs: Sequence[Any], work: Any) -> list[Any]:
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), jobs))


def _forest_scores(family: Family, candidates: list[dict], ready: DataFrame, check: DataFrame, inputs: int, n: int) -> list[float]:
    model = family.build(forest.largest(candidates), inputs, float(n)).fit(ready)
    return forest.nested_scores(model, candidates, check, len(families.CLASSES))


def _neighbour_scores(family: Family, candidates: list[dict], ready: DataFrame, check: DataFrame, inputs: int, n: int) -> list[float]:
    return [MacroF1Evaluator().evaluate(families.with_label_text(p)) for p in knn.nested_scores(candidates, ready, check)]


# Families in which one fit or search answers for every setting.
NESTED = {"random_forest": _forest_scores, "knn": _neighbour_scores}


def _scores_by_fold(kept: DataFrame, features: Sequence[str], searched: dict[str, Family], used: list[int]) -> dict[str, list[list[float]]]:
    """Per family, candidate and fold the score of models fitted setting by setting or from one nested fit.

    What does not depend on the candidate, the fold filter, the imputation and
    the scaling, is done once per fold.
    """
    level, found = StorageLevel.MEMORY_AND_DISK, {name: [[] for _ in f.candidates()] for name, f in searched.items()}
    for fold in used if searched else []:
        part, held = kept.where(F.col("fold") != fold), kept.where(F.col("fold") == fold)
        for scaled in sorted({f.scaled for f in searched.values()}):
            prep = families.preprocessing(features, scaled).fit(part)
            ready = families.with_balanced_weight(prep.transform(part)).persist(level)
            check = prep.transform(held).persist(level)
            n = ready.count()
            jobs: list[tuple[str, list[int]]] = []
            for name, f in searched.items():
                if f.scaled == scaled:
                    places = list(range(len(f.candidates())))
                    jobs += [(name, places)] if name in NESTED else [(name, [i]) for i in places]

            def run(job: tuple[str, list[int]]) -> list[float]:
                name, places = job
                family, candidates = searched[name], [searched[name].candidates()[i] for i in places]
                if name in NESTED:
                    return NESTED[name](family, candidates, ready, check, len(features), n)
                return [_score(family.build(p, len(features), float(n)).fit(ready), check) for p in candidates]

            for (name, places), scores in zip(jobs, _parallel(kept.sparkSession, jobs, run)):
                for i, score in zip(places, scores):
                    found[name][i].append(score)
            ready.unpersist()
            check.unpersist()
    return found


def tune(
    train: DataFrame,
    spec: PanelSpec,
    features: Sequence[str],
    chosen: dict[str, Family] | None = None,
    folds: int = 5,
    seed: int = SEED,
) -> Tuned:
    """Mean macro-F1 over folds per candidate, first best wins, refit on all rows.

    A family without a grid is only fitted and has no cross-validated score.
    Families that train together take all candidates, all folds and the refit in
    the same passes.
    """
    chosen = chosen or families.FAMILIES
    ensure_checkpoint_dir(train.sparkSession)
    rows = _modelling_rows(train, spec, features)
    assignment = splitting.group_kfold(train, spec, folds, seed).select(spec.subject, "fold")
    # One copy with folds serves every fit below.
    kept = rows.join(assignment, spec.subject).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total = kept.count()
        used = [r.fold for r in kept.select("fold").distinct().orderBy("fold").collect()]
        apart = {name: f for name, f in chosen.items() if f.grid and f.together is None}
        scores = _scores_by_fold(kept, features, apart, used)
        shared = together.Shared(kept, features, len(families.CLASSES), "fold", used)
        results = {name: f.together(shared, f.candidates()) for name, f in chosen.items() if f.grid and f.together is not None}
        scores |= {name: r.scores(used) for name, r in results.items()}

        def refit(item: tuple[str, Family]) -> tuple[str, Model, tuple]:
            name, family = item
            candidates = family.candidates()
            if not family.grid:
                return name, families.fit(family, {}, kept, features, total), (name, None, "{}", 1)
            means = [sum(s) / len(s) for s in scores[name]]
            best = max(range(len(candidates)), key=lambda i: (means[i], -i))
            record = (name, means[best], json.dumps(candidates[best], sort_keys=True), len(candidates))
            if name in results:
                return name, results[name].refit(best), record
            return name, families.fit(family, candidates[best], kept, features, total), record

        done = _parallel(train.sparkSession, list(chosen.items()), refit)
    finally:
        kept.unpersist()
    tuning = train.sparkSession.createDataFrame([r for _, _, r in done], RESULT_SCHEMA)
    return Tuned({name: model for name, model, _ in done}, tuning)


def predict(model: Model, rows: DataFrame, spec: PanelSpec, features: Sequence[str]) -> DataFrame:
    """(subject, day, label, prediction) with labels as text."""
    ready = _modelling_rows(rows, spec, features)
    return families.with_label_text(model.transform(ready)).select(*spec.key, "label", "prediction")


def fit_predict(
    train: DataFrame, test: DataFrame, spec: PanelSpec, features: Sequence[str], family: Family, params: dict
) -> DataFrame:
    """One configuration fitted on train rows, applied to test rows, keys kept."""
    rows = _modelling_rows(train, spec, features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total = rows.count()
        model = families.fit(family, params, rows, features, total)
    finally:
        rows.unpersist()
    return predict(model, test, spec, features)


def compare_models(
    train: DataFrame,
    test: DataFrame,
    spec: PanelSpec,
    features: Sequence[str],
    chosen: dict[str, Family] | None = None,
    folds: int = 5,
) -> DataFrame:
    """Tune every family on train subjects and evaluate it once on test subjects."""
    return compare_with_matrices(train, test, spec, features, chosen, folds)[0]


def compare_with_matrices(
    train: DataFrame,
    test: DataFrame,
    spec: PanelSpec,
    features: Sequence[str],
    chosen: dict[str, Family] | None = None,
    folds: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """Results of ``compare_models`` and the confusion matrix of every family."""
    spark = train.sparkSession
    tuned = tune(train, spec, features, chosen, folds)
    scored = union_conditions(
        {name: predict(m, test, spec, features) for name, m in tuned.models.items()}, "model"
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        results = with_tuning(evaluate(scored, ["model"]), tuned.tuning, ["model"])
        matrix = confusion_percent(confusion_matrix(scored, ["model"]), ["model"])
        # A few rows per family: evaluated now, while the caller keeps its input cached.
        return tuple(spark.createDataFrame(f.collect(), f.schema) for f in (results, matrix))
    finally:
        scored.unpersist()


def best_against_baseline(results: DataFrame, baseline: str = "majority_baseline") -> DataFrame:
    """Results with their lead over the baseline and the hardest label of each."""
    reference = results.where(F.col("model") == baseline).agg(F.max("macro_f1")).scalar()
    by_label = F.array(
        *[
            F.struct(F.col(f"{x.lower()}_f1").alias("f1"), F.lit(i).alias("place"), F.lit(x).alias("label"))
            for i, x in enumerate(LABELS)
        ]
    )
    return results.withColumn("lead", F.col("macro_f1") - reference).withColumn(
        "hardest_label", F.array_min(by_label)["label"]
    )


def compare_feature_sets(
    panel: DataFrame,
    spec: PanelSpec,
    conditions: dict[str, Sequence[str]],
    chosen: dict[str, Family] | None = None,
    folds: int = 5,
    split: str = "split",
) -> DataFrame:
    """The model comparison once per named feature set, results stacked."""
    used = sorted({c for columns in conditions.values() for c in columns})
    shared = panel.select(*spec.key, spec.label, split, *used).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train, test = splitting.split_parts(shared, split)

        def run(item: tuple[str, Sequence[str]]) -> tuple[str, DataFrame]:
            name, features = item
            result = compare_models(train, test, spec, features, chosen, folds)
            return name, result.withColumn("n_features", F.lit(len(features)))

        frames = dict(_parallel(panel.sparkSession, list(conditions.items()), run))
    finally:
        shared.unpersist()
    return union_conditions(frames)


def run_experiments(
    panel: DataFrame,
    spec: PanelSpec,
    experiments: dict[str, dict[str, Sequence[str]]],
    chosen: dict[str, Family] | None = None,
    folds: int = 5,
    split: str = "split",
) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(results, confusion matrices) of each experiment's feature sets.

    A feature set that several experiments share is tuned once. Results carry
    the lead over the baseline of the same feature set and the hardest label.
    """
    sets = {tuple(f): None for conditions in experiments.values() for f in conditions.values()}
    used = sorted({c for features in sets for c in features})
    shared = panel.select(*spec.key, spec.label, split, *used).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train, test = splitting.split_parts(shared, split)

        def run(features: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
            results, matrix = compare_with_matrices(train, test, spec, features, chosen, folds)
            return best_against_baseline(results).withColumn("n_features", F.lit(len(features))), matrix

        found = dict(zip(sets, _parallel(panel.sparkSession, list(sets), run)))
    finally:
        shared.unpersist()
    return {
        name: tuple(union_conditions({c: found[tuple(f)][part] for c, f in conditions.items()}) for part in (0, 1))
        for name, conditions in experiments.items()
    }


def best_overall(results: DataFrame) -> DataFrame:
    """The one row with the highest score, ties by condition and model."""
    return best_per_condition(results).orderBy(F.desc("macro_f1"), "condition", "model").limit(1)


def best_per_condition(results: DataFrame) -> DataFrame:
    return best_per_group(results, ["condition"], "macro_f1", ["model"])


def leave_one_subject_out(
    train: DataFrame, spec: PanelSpec, features: Sequence[str], family: Family, params: dict
) -> DataFrame:
    """One model per training subject: (subject, n_rows, macro_f1).

    Forests are grown for all subjects at once. Families that train together take FLEET subjects in the same passes, so the
    jobs do not grow with the subjects up to that number. Others are fitted
    apart, PARALLEL_FITS at once. Either way there are as many models as
    subjects, and the driver holds one score for each of a part of them.
    """
    rows = _modelling_rows(train, spec, features).persist(StorageLevel.MEMORY_AND_DISK)
    spark = train.sparkSession
    schema = f"{spec.subject} string, n_rows bigint, macro_f1 double"
    try:
        if family.left_out is not None:
            said = family.left_out(rows, spec.subject, features, len(families.CLASSES), params)
            said = families.with_label_text(families.with_label_text(said), "label_index").withColumnRenamed("label_index", "label")
            n_rows = sum(F.col(f"{x.lower()}_support") for x in LABELS)
            scores = evaluate(said, [spec.subject]).select(
                F.col(spec.subject).cast("string"), n_rows.cast("bigint").alias("n_rows"), F.coalesce("macro_f1", F.lit(0.0)).alias("macro_f1")
            )
            return cut_lineage(scores)
        total = rows.count()
        counted = rows.groupBy(spec.subject).agg(F.count("*").alias("n"))

        def run(job: tuple[str, int]) -> tuple[str, int, float]:
            subject, n = job
            own = F.col(spec.subject) == subject
            model = families.fit(family, params, rows.where(~own), features, total - n)
            return subject, n, _score(model, rows.where(own))

        def fleet_of(jobs: list[tuple[str, int]]) -> list[tuple[str, int, float]]:
            numbers = {subject: i for i, (subject, _) in enumerate(jobs)}
            kind = rows.schema[spec.subject].dataType.simpleString()
            named = spark.createDataFrame(list(numbers.items()), f"{spec.subject} {kind}, _code int")
            # Rows of subjects outside this fleet are learnt from by all its models.
            coded = rows.join(named, spec.subject, "left").withColumn("_code", F.coalesce("_code", F.lit(len(jobs))))
            shared = together.Shared(coded, features, len(families.CLASSES), "_code", list(numbers.values()))
            confusions = family.together(shared, [params], whole=False).confusions[0]
            return [(s, n, fleet.macro_f1(confusions[numbers[s]])) for s, n in jobs]

        numbers = (len(families.CLASSES) * (len(features) + 1)) ** 2
        most = max(1, min(FLEET, FLEET_NUMBERS // numbers)) if family.together is not None else PARALLEL_FITS
        parts, waiting = [], []
        for row in chain(counted.toLocalIterator(), [None]):
            if row is not None:
                waiting.append((row[0], row.n))
            if waiting and (row is None or len(waiting) == most):
                done = fleet_of(waiting) if family.together is not None else _parallel(spark, waiting, run)
                parts.append(spark.createDataFrame(done, schema))
                waiting = []
    finally:
        rows.unpersist()
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
