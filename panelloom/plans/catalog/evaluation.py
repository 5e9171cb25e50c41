"""Metrics of a deterministic predictor, followed end to end by SQL.

Test subjects are predicted by their previous observation's label, and by the
training majority where there is none.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.functions import ordering
from panelloom.models import evaluate, knn, robustness
from panelloom.operators import compare, temporal
from panelloom.plans import panels
from panelloom.plans.catalog.registry import (
    LABEL_LIST,
    METRICS,
    PREDICTIONS,
    SPLIT,
    metric_sql,
    query,
)
from panelloom.sources import readings as src
from panelloom.spec import BOOTSTRAP_DRAWS, EVENTS, LABELS

DRAWS = BOOTSTRAP_DRAWS


def majority_label(train):
    counts = train.groupBy("label").agg(F.count("*").alias("n"))
    return counts.agg(F.min_by("label", F.struct(-F.col("n"), "label"))).scalar()


def predictions(spark, folder):
    panel = panels.split_panel(spark, folder).select(*EVENTS.key, "label", "split", "is_weekend")
    previous = temporal.previous_value(panel.where(F.col("split") == "test"), EVENTS, "label", "prediction")
    majority = majority_label(panel.where(F.col("split") == "train"))
    return previous.withColumn("prediction", F.coalesce("prediction", majority))


@query(
    "majority_baseline",
    f"WITH {PREDICTIONS} SELECT subject_id, day, label, (SELECT label FROM majority) AS prediction FROM predictions",
)
def majority_baseline(spark, folder):
    panel = panels.split_panel(spark, folder).select(*EVENTS.key, "label", "split")
    majority = majority_label(panel.where(F.col("split") == "train"))
    test = panel.where(F.col("split") == "test").drop("split")
    return test.withColumn("prediction", majority)


_CELLS = ", ".join(
    f"count(p.label) FILTER (WHERE p.prediction = '{x}') AS predicted_{x.lower()}" for x in ("Low", "Medium", "High")
)
_MATRIX = f"""matrix AS (SELECT names.label AS actual, {_CELLS}
FROM {LABEL_LIST} LEFT JOIN predictions p ON p.label = names.label GROUP BY 1)"""


@query("confusion_matrix", f"WITH {PREDICTIONS}, {_MATRIX} SELECT * FROM matrix")
def confusion_matrix(spark, folder):
    return evaluate.confusion_matrix(predictions(spark, folder))


_SHARES = ["predicted_low", "predicted_medium", "predicted_high"]


@query(
    "confusion_row_percent",
    f"WITH {PREDICTIONS}, {_MATRIX} SELECT *, "
    + ", ".join(
        f"coalesce({c} * 100.0 / nullif(predicted_low + predicted_medium + predicted_high, 0), 0) AS {c}_percent"
        for c in _SHARES
    )
    + " FROM matrix",
    " ".join(f"{c}_percent" for c in _SHARES),
)
def confusion_row_percent(spark, folder):
    return evaluate.confusion_percent(evaluate.confusion_matrix(predictions(spark, folder)))


@query("macro_metrics", f"WITH {PREDICTIONS} {metric_sql('predictions')}", METRICS)
def macro_metrics(spark, folder):
    return evaluate.evaluate(predictions(spark, folder))


@query(
    "per_class_metrics",
    f"""WITH {PREDICTIONS}, c AS (
  SELECT names.label, count(*) FILTER (WHERE p.label = names.label AND p.prediction = names.label) AS hit,
         count(*) FILTER (WHERE p.label = names.label) AS support,
         count(*) FILTER (WHERE p.prediction = names.label) AS predicted
  FROM {LABEL_LIST} CROSS JOIN predictions p GROUP BY 1)
SELECT label, coalesce(hit * 1.0 / nullif(predicted, 0), 0) AS precision,
       coalesce(hit * 1.0 / nullif(support, 0), 0) AS recall,
       coalesce(2.0 * hit / nullif(support + predicted, 0), 0) AS f1, support FROM c""",
    "precision recall f1",
)
def per_class_metrics(spark, folder):
    return evaluate.per_class(predictions(spark, folder))


@query(
    "hardest_class",
    f"""WITH {PREDICTIONS}, c AS (
  SELECT names.label, count(*) FILTER (WHERE p.label = names.label AND p.prediction = names.label) AS hit,
         count(*) FILTER (WHERE p.label = names.label) + count(*) FILTER (WHERE p.prediction = names.label) AS seen
  FROM {LABEL_LIST} CROSS JOIN predictions p GROUP BY 1)
SELECT label, coalesce(2.0 * hit / nullif(seen, 0), 0) AS f1 FROM c
ORDER BY f1, list_position(['Low', 'Medium', 'High'], label) LIMIT 1""",
    "f1",
)
def hardest_class(spark, folder):
    return evaluate.hardest_class(evaluate.per_class(predictions(spark, folder)))


@query(
    "hardest_class_constant",
    f"""WITH {PREDICTIONS}, c AS (
  SELECT constant.label AS prediction, names.label,
         count(*) FILTER (WHERE p.label = names.label AND constant.label = names.label) AS hit,
         count(*) FILTER (WHERE p.label = names.label) + count(*) FILTER (WHERE constant.label = names.label) AS seen
  FROM {LABEL_LIST} CROSS JOIN (VALUES ('Low'), ('Medium'), ('High')) AS constant(label) CROSS JOIN predictions p
  GROUP BY ALL)
SELECT prediction, label, coalesce(2.0 * hit / nullif(seen, 0), 0) AS f1 FROM c
QUALIFY row_number() OVER (
  PARTITION BY prediction ORDER BY f1, list_position(['Low', 'Medium', 'High'], label)) = 1""",
    "f1",
)
def hardest_class_constant(spark, folder):
    """Predictors that always say one label: the other two tie at zero."""
    rows = predictions(spark, folder)
    frames = {
        x: evaluate.hardest_class(evaluate.per_class(rows.withColumn("prediction", F.lit(x)))) for x in LABELS
    }
    return compare.union_conditions(frames, "prediction")


_SUBJECT_METRICS = metric_sql("predictions", "subject_id")


@query(
    "per_subject_macro_f1",
    f"WITH {PREDICTIONS} SELECT subject_id, accuracy, macro_f1 FROM ({_SUBJECT_METRICS})",
    "accuracy macro_f1",
)
def per_subject_macro_f1(spark, folder):
    return robustness.per_subject_scores(predictions(spark, folder), "subject_id")


@query(
    "per_subject_summary",
    f"""WITH {PREDICTIONS} SELECT count(*) AS n_subjects, avg(macro_f1) AS mean_macro_f1,
       stddev_samp(macro_f1) AS sd_macro_f1, min(macro_f1) AS min_macro_f1, max(macro_f1) AS max_macro_f1
FROM ({_SUBJECT_METRICS})""",
    "mean_macro_f1 sd_macro_f1 min_macro_f1 max_macro_f1",
)
def per_subject_summary(spark, folder):
    scores = robustness.per_subject_scores(predictions(spark, folder), "subject_id")
    return robustness.subject_score_summary(scores)


_BOOTSTRAP = f"""{PREDICTIONS},
numbered AS (
  SELECT subject_id, row_number() OVER (ORDER BY md5('49:' || subject_id), subject_id) - 1 AS slot
  FROM (SELECT DISTINCT subject_id FROM predictions)),
picks AS (
  SELECT draw, CAST('0x' || substring(md5('49:' || draw || ':' || slot), 1, 15) AS BIGINT)
               % (SELECT count(*) FROM numbered) AS pick
  FROM numbered CROSS JOIN range({DRAWS}) AS t(draw)),
resampled AS (
  SELECT draw, label, prediction FROM picks JOIN numbered ON slot = pick JOIN predictions USING (subject_id)),
draws AS (SELECT draw, macro_f1 FROM ({metric_sql('resampled', 'draw')}))"""


@query("bootstrap_draws", f"WITH {_BOOTSTRAP} SELECT CAST(draw AS INTEGER) AS draw, macro_f1 FROM draws", "macro_f1")
def bootstrap_draws(spark, folder):
    return robustness.bootstrap_draws(predictions(spark, folder), "subject_id", draws=DRAWS)


@query(
    "bootstrap_macro_f1",
    f"""WITH {_BOOTSTRAP} SELECT avg(macro_f1) AS mean_macro_f1, quantile_cont(macro_f1, 0.025) AS ci_lower_2_5,
       quantile_cont(macro_f1, 0.975) AS ci_upper_97_5, count(*) AS n_draws,
       (SELECT macro_f1 FROM ({metric_sql('predictions')})) AS point_macro_f1 FROM draws""",
    "mean_macro_f1 ci_lower_2_5 ci_upper_97_5 point_macro_f1",
)
def bootstrap_macro_f1(spark, folder):
    rows = predictions(spark, folder)
    draws = robustness.bootstrap_draws(rows, "subject_id", draws=DRAWS)
    return robustness.bootstrap_summary(draws, evaluate.evaluate(rows))


@query(
    "logo_majority",
    f"""WITH {SPLIT}, train AS (SELECT * FROM split_panel WHERE split = 'train'),
subjects_out AS (SELECT DISTINCT subject_id FROM train),
chosen AS (
  SELECT s.subject_id, (SELECT t.label FROM train t WHERE t.subject_id <> s.subject_id
                        GROUP BY t.label ORDER BY count(*) DESC, t.label LIMIT 1) AS prediction FROM subjects_out s),
held_out AS (SELECT subject_id, label, prediction FROM train JOIN chosen USING (subject_id))
SELECT m.subject_id, n_rows, prediction, macro_f1 FROM ({metric_sql('held_out', 'subject_id')}) m
JOIN chosen USING (subject_id) JOIN (SELECT subject_id, count(*) AS n_rows FROM train GROUP BY 1) USING (subject_id)""",
    "macro_f1",
)
def logo_majority(spark, folder):
    train = panels.split_panel(spark, folder).where(F.col("split") == "train")
    return robustness.leave_one_out_majority(train, "subject_id", "label")


# Three conditions of the same predictor: all days, weekdays, weekends.
def _conditions(spark, folder):
    rows = predictions(spark, folder)
    frames = {
        "all_days": rows,
        "weekday": rows.where(F.col("is_weekend") == 0),
        "weekend": rows.where(F.col("is_weekend") == 1),
    }
    per_condition = {name: robustness.per_subject_scores(f, "subject_id") for name, f in frames.items()}
    return compare.union_conditions(per_condition)


def _condition_sql(where: str, name: str) -> str:
    return f"""{name}_rows AS (SELECT * FROM predictions WHERE {where}),
{name} AS (SELECT '{name}' AS condition, subject_id, accuracy, macro_f1
  FROM ({metric_sql(name + '_rows', 'subject_id')}))"""


_CONDITIONS = (
    PREDICTIONS
    + ", "
    + ", ".join(
        _condition_sql(w, n) for n, w in (("all_days", "true"), ("weekday", "is_weekend = 0"), ("weekend", "is_weekend = 1"))
    )
    + ", stacked AS (SELECT * FROM all_days UNION ALL SELECT * FROM weekday UNION ALL SELECT * FROM weekend)"
)


@query("union_conditions", f"WITH {_CONDITIONS} SELECT * FROM stacked", "accuracy macro_f1")
def union_conditions(spark, folder):
    return _conditions(spark, folder)


@query(
    "best_per_group",
    f"""WITH {_CONDITIONS} SELECT condition, subject_id, accuracy, macro_f1 FROM stacked
QUALIFY row_number() OVER (PARTITION BY condition ORDER BY round(macro_f1, 9) DESC, subject_id) = 1""",
    "accuracy macro_f1",
)
def best_per_group(spark, folder):
    scored = _conditions(spark, folder).withColumn("_m", F.round("macro_f1", 9))
    return compare.best_per_group(scored, ["condition"], "_m", ["subject_id"]).drop("_m")


@query(
    "delta_vs_baseline",
    f"""WITH {_CONDITIONS} SELECT *, macro_f1 - (SELECT max(macro_f1) FROM stacked WHERE condition = 'all_days') AS delta,
       macro_f1 - 0.357 AS delta_vs_constant FROM stacked""",
    "accuracy macro_f1 delta delta_vs_constant",
)
def delta_vs_baseline(spark, folder):
    rows = compare.delta_vs_baseline(_conditions(spark, folder), "macro_f1", "condition", "all_days")
    return compare.delta_vs_constant(rows, "macro_f1", 0.357, "delta_vs_constant")


@query(
    "fold_summary",
    f"""WITH {_CONDITIONS} SELECT condition, avg(macro_f1) AS macro_f1_mean, stddev_pop(macro_f1) AS macro_f1_sd,
       avg(macro_f1) - (SELECT avg(macro_f1) FROM stacked WHERE condition = 'all_days') AS delta_vs_baseline
FROM stacked GROUP BY 1""",
    "macro_f1_mean macro_f1_sd delta_vs_baseline",
)
def fold_summary(spark, folder):
    return robustness.fold_summary(_conditions(spark, folder), "condition", "all_days")


K = 5
_KNN = f"""vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
         row_number() OVER (ORDER BY md5('49:' || vec_id), vec_id) - 1
         < ceil(0.25 * (SELECT count(*) FROM embeddings)) AS is_test FROM embeddings),
ranked AS (
  SELECT t.vec_id, n.vec_id AS neighbour, n.label, list_distance(t.v, n.v) AS distance,
         row_number() OVER (PARTITION BY t.vec_id ORDER BY list_distance(t.v, n.v), n.vec_id) AS place
  FROM vectors t JOIN vectors n ON t.is_test AND NOT n.is_test),
nearest AS (SELECT * FROM ranked WHERE place <= {K})"""


def _vectors(spark, folder):
    vectors = src.table(spark, folder, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("v")
    )
    numbered = ordering.with_hash_ordinal(vectors, ["vec_id"], 49)
    total = vectors.agg(F.count("*")).scalar()
    is_test = F.col("ordinal") < F.ceil(total * F.lit(0.25))
    return numbered.where(~is_test), numbered.where(is_test)


def _neighbours(spark, folder):
    train, test = _vectors(spark, folder)
    return knn.nearest_neighbours(train, test, K, "vec_id", "vec_id", "v", "label")


@query(
    "nearest_neighbours",
    f"WITH {_KNN} SELECT vec_id, neighbour, distance, CAST(place AS INTEGER) AS place, label FROM nearest",
    "distance",
)
def nearest_neighbours(spark, folder):
    return _neighbours(spark, folder).select("vec_id", "neighbour", "distance", "place", "label")


@query(
    "knn",
    f"""WITH {_KNN}, votes AS (SELECT vec_id, label, count(*) AS n FROM nearest GROUP BY 1, 2)
SELECT vec_id, label AS prediction FROM votes QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) = 1""",
)
def nearest_neighbour_vote(spark, folder):
    return knn.vote(_neighbours(spark, folder), "vec_id", "label")


