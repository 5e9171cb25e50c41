"""Splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import split
from panelloom.plans import panels
from panelloom.plans.catalog.registry import PANEL, SPLIT, query
from panelloom.spec import EVENTS

KEY = EVENTS.key


@query("subject_split", f"WITH {SPLIT} SELECT subject_id, n_rows, low, medium, high, split FROM assignment")
def subject_split(spark, folder):
    return split.subject_split(panels.panel(spark, folder), EVENTS)


@query(
    "hash_split",
    f"""WITH {PANEL} SELECT DISTINCT subject_id,
       CASE WHEN CAST('0x' || substring(md5('49:' || subject_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.25
            THEN 'test' ELSE 'train' END AS split FROM panel""",
)
def hash_split(spark, folder):
    subjects = panels.panel(spark, folder).select("subject_id").distinct()
    return subjects.withColumn("split", split.hash_split(F.col("subject_id")))


@query("assign_split", f"WITH {SPLIT} SELECT subject_id, day, label, split FROM split_panel")
def assign_split(spark, folder):
    return panels.split_panel(spark, folder).select(*KEY, "label", "split")


@query(
    "split_integrity",
    f"""WITH {SPLIT} SELECT subject_id, CASE WHEN count(DISTINCT split) = 1 THEN min(split) ELSE 'mixed' END AS split,
       count(*) AS n_rows FROM split_panel GROUP BY 1""",
)
def split_integrity(spark, folder):
    return split.split_integrity(panels.split_panel(spark, folder), EVENTS)


@query(
    "group_kfold",
    f"""WITH RECURSIVE {SPLIT},
queue AS (
  SELECT subject_id, n_rows,
         row_number() OVER (ORDER BY n_rows DESC, md5('49:' || subject_id), subject_id) AS place FROM subjects),
greedy AS (
  SELECT CAST(0 AS BIGINT) AS place, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS loads, CAST('' AS VARCHAR) AS subject_id,
         CAST(0 AS BIGINT) AS n_rows, CAST(0 AS INTEGER) AS fold
  UNION ALL
  SELECT q.place, list_transform(range(1, 6), lambda i: loads[i] + CASE WHEN i = lightest THEN q.n_rows ELSE 0 END),
         q.subject_id, q.n_rows, CAST(lightest - 1 AS INTEGER)
  FROM (SELECT *, list_position(loads, list_min(loads)) AS lightest FROM greedy) g
  JOIN queue q ON q.place = g.place + 1)
SELECT subject_id, n_rows, fold FROM greedy WHERE place > 0""",
)
def group_kfold(spark, folder):
    return split.group_kfold(panels.panel(spark, folder), EVENTS)


@query(
    "hash_fold",
    f"""WITH {PANEL} SELECT DISTINCT subject_id,
       CAST(CAST('0x' || substring(md5('49:' || subject_id), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM panel""",
)
def hash_fold(spark, folder):
    subjects = panels.panel(spark, folder).select("subject_id").distinct()
    return subjects.withColumn("fold", split.hash_fold(F.col("subject_id"), 5))


@query("leave_one_out_folds", f"WITH {SPLIT} SELECT subject_id, day, subject_id AS fold FROM split_panel WHERE split = 'train'")
def leave_one_out_folds(spark, folder):
    train = panels.split_panel(spark, folder).where(F.col("split") == "train")
    return split.leave_one_out_folds(train, EVENTS).select(*KEY, "fold")


_ORDER = "row_number() OVER (PARTITION BY label ORDER BY md5('49:' || subject_id || ':' || day), subject_id, day) - 1"


@query(
    "stratified_kfold",
    f"WITH {PANEL} SELECT subject_id, day, label, CAST(({_ORDER}) % 5 AS INTEGER) AS fold FROM panel",
)
def stratified_kfold(spark, folder):
    rows = panels.panel(spark, folder).select(*KEY, "label")
    return split.stratified_kfold(rows, KEY, "label")


@query(
    "stratified_holdout",
    f"""WITH {PANEL} SELECT subject_id, day, label,
       CASE WHEN {_ORDER} < floor(count(*) OVER (PARTITION BY label) * 0.2 + 0.5) THEN 'validation' ELSE 'fit' END AS part
FROM panel""",
)
def stratified_holdout(spark, folder):
    rows = panels.panel(spark, folder).select(*KEY, "label")
    return split.stratified_holdout(rows, KEY, "label")
