"""Coverage of target days, audits per kind of reading, key comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import coverage
from panelloom.plans import panels
from panelloom.plans.catalog.registry import MODALITY, READINGS, query
from panelloom.sources import readings as src
from panelloom.spec import EVENTS

KEY = EVENTS.key
MODALITIES = list(src.EVENT_MODALITIES.values())
WEARABLES = src.EVENT_WEARABLES

TAGGED = f"{READINGS}, tagged AS (SELECT *, {MODALITY} AS modality FROM readings)"
KINDS = "(VALUES ('target'), ('sleep'), ('movement'), ('activity'), ('oxygen')) AS kinds(modality)"
COVERAGE = f"""{TAGGED},
days AS (SELECT DISTINCT subject_id, day, modality FROM tagged),
target_days AS (SELECT subject_id, day FROM days WHERE modality = 'target'),
subjects AS (SELECT DISTINCT subject_id FROM tagged),
coverage AS (
  SELECT s.subject_id, kinds.modality,
         (SELECT count(*) FROM target_days t WHERE t.subject_id = s.subject_id) AS target_days,
         (SELECT count(*) FROM target_days t JOIN days d USING (subject_id, day)
          WHERE t.subject_id = s.subject_id AND d.modality = kinds.modality) AS covered_target_days
  FROM subjects s CROSS JOIN {KINDS}
),
covered AS (
  SELECT subject_id, target_days, modality, covered_target_days,
         CASE WHEN target_days = 0 THEN 0 ELSE covered_target_days * 100.0 / target_days END AS target_coverage_percent
  FROM coverage
)"""


def _flags(spark, folder):
    return coverage.day_flags(panels.readings(spark, folder), KEY, MODALITIES, "target", "value")


def _coverage(spark, folder):
    return coverage.target_coverage(_flags(spark, folder), "subject_id", MODALITIES, "target")


@query("target_coverage", f"WITH {COVERAGE} SELECT * FROM covered", "target_coverage_percent")
def target_coverage(spark, folder):
    return _coverage(spark, folder)


@query(
    "coverage_summary",
    f"""WITH {COVERAGE}
SELECT modality, count(*) AS subjects, CAST(sum(target_days) AS BIGINT) AS total_target_days,
       CAST(sum(covered_target_days) AS BIGINT) AS covered_target_days,
       avg(target_coverage_percent) AS mean_subject_coverage_percent,
       sum(covered_target_days) * 100.0 / sum(target_days) AS overall_coverage_percent
FROM covered GROUP BY 1""",
    "mean_subject_coverage_percent overall_coverage_percent",
)
def coverage_summary(spark, folder):
    return coverage.coverage_summary(_coverage(spark, folder), "subject_id")


@query(
    "lowest_coverage",
    f"WITH {COVERAGE} SELECT * FROM covered ORDER BY target_coverage_percent, subject_id, modality LIMIT 10",
    "target_coverage_percent",
)
def lowest_coverage(spark, folder):
    """The ten lowest subject and kind pairs: a report whose feature is the limit."""
    from panelloom.operators.profile import lowest_coverage as lowest

    return lowest(_coverage(spark, folder), "subject_id", 10)


@query(
    "complete_coverage",
    f"""WITH {COVERAGE}
SELECT subject_id, day FROM days GROUP BY 1, 2 HAVING count(DISTINCT modality) = 5""",
)
def complete_coverage(spark, folder):
    return coverage.complete_days(_flags(spark, folder), WEARABLES, "target")


_FILES = "files AS (SELECT DISTINCT subject_id, modality FROM tagged)"


_AVAILABILITY = f"""{COVERAGE}, {_FILES},
complete AS (SELECT subject_id, day FROM days GROUP BY 1, 2 HAVING count(DISTINCT modality) = 5),
per_subject AS (
  SELECT subject_id, CAST(count(DISTINCT modality) = 5 AS INTEGER) AS has_all_modalities,
         (SELECT count(*) FROM target_days t WHERE t.subject_id = files.subject_id) AS target_days,
         (SELECT count(*) FROM complete c WHERE c.subject_id = files.subject_id) AS complete_target_days
  FROM files GROUP BY subject_id)"""


@query(
    "subject_availability",
    f"""WITH {_AVAILABILITY}
SELECT *, CASE WHEN target_days = 0 THEN 0 ELSE complete_target_days * 100.0 / target_days END
          AS complete_target_percent FROM per_subject""",
    "complete_target_percent",
)
def subject_availability(spark, folder):
    return _availability(spark, folder)


@query(
    "audit_summary",
    f"""WITH {_AVAILABILITY}
SELECT count(*) AS subjects, CAST(sum(has_all_modalities) AS BIGINT) AS subjects_with_all_modalities,
       CAST(sum(target_days) AS BIGINT) AS target_days, CAST(sum(complete_target_days) AS BIGINT)
       AS complete_target_days, sum(complete_target_days) * 100.0 / sum(target_days) AS complete_target_percent
FROM per_subject""",
    "complete_target_percent",
)
def audit_summary(spark, folder):
    return coverage.audit_summary(_availability(spark, folder))


def _availability(spark, folder):
    readings = panels.readings(spark, folder)
    files = readings.select("subject_id", "modality").distinct()
    return coverage.subject_availability(_flags(spark, folder), "subject_id", MODALITIES, WEARABLES, "target", files)


_AUDIT = f"""{TAGGED},
grid AS (SELECT subject_id, kinds.modality FROM (SELECT DISTINCT subject_id FROM tagged) CROSS JOIN {KINDS}),
observed AS (
  SELECT subject_id, modality, count(*) AS rows, count(DISTINCT day) AS unique_days,
         CAST(sum(CAST(value IS NULL AS INT) + CAST(k IS NULL AS INT)) AS BIGINT) AS missing_cells,
         2 * count(*) AS total_cells, min(day) AS min_day, max(day) AS max_day
  FROM tagged GROUP BY 1, 2),
audit AS (
  SELECT g.subject_id, g.modality, CAST(o.rows IS NOT NULL AS INTEGER) AS "exists", coalesce(o.rows, 0) AS rows,
         coalesce(unique_days, 0) AS unique_days, coalesce(missing_cells, 0) AS missing_cells,
         coalesce(total_cells, 0) AS total_cells, min_day, max_day,
         CASE WHEN coalesce(total_cells, 0) = 0 THEN 0 ELSE missing_cells * 100.0 / total_cells END AS missing_percent
  FROM grid g LEFT JOIN observed o ON g.subject_id = o.subject_id AND g.modality = o.modality)"""


def _audit(spark, folder):
    values = {m: ["value", "k"] for m in MODALITIES}
    return coverage.modality_audit(panels.readings(spark, folder), "subject_id", "day", values)


@query("modality_audit", f"WITH {_AUDIT} SELECT * FROM audit", "missing_percent")
def modality_audit(spark, folder):
    return _audit(spark, folder)


@query(
    "missing_files",
    f"""WITH {_AUDIT} SELECT modality, count(*) FILTER (WHERE "exists" = 0) AS subjects_without FROM audit GROUP BY 1""",
)
def missing_files(spark, folder):
    return coverage.missing_files(_audit(spark, folder))


# Days with a target against days with any wearable reading.
_SIDES = f"""{TAGGED},
l AS (SELECT DISTINCT subject_id, day FROM tagged WHERE modality = 'target'),
r AS (SELECT DISTINCT subject_id, day FROM tagged WHERE modality <> 'target')"""


def _sides(spark, folder):
    readings = panels.readings(spark, folder).select(*KEY, "modality")
    return readings.where(F.col("modality") == "target"), readings.where(F.col("modality") != "target")


@query(
    "key_diff",
    f"""WITH {_SIDES}
SELECT subject_id, count(lk) AS left_days, count(rk) AS right_days, count(*) FILTER (WHERE lk AND rk) AS kept,
       count(*) FILTER (WHERE lk AND rk IS NULL) AS dropped, count(*) FILTER (WHERE lk IS NULL AND rk) AS extra
FROM (SELECT *, true AS lk FROM l) FULL JOIN (SELECT *, true AS rk FROM r) USING (subject_id, day) GROUP BY 1""",
)
def key_diff(spark, folder):
    left, right = _sides(spark, folder)
    return coverage.key_diff(left, right, KEY, "subject_id")


@query(
    "key_set_ops",
    f"""WITH {_SIDES}
SELECT (SELECT count(*) FROM (SELECT * FROM l INTERSECT SELECT * FROM r)) AS in_both,
       (SELECT count(*) FROM (SELECT * FROM l EXCEPT SELECT * FROM r)) AS left_only,
       (SELECT count(*) FROM (SELECT * FROM r EXCEPT SELECT * FROM l)) AS right_only""",
)
def key_set_ops(spark, folder):
    left, right = _sides(spark, folder)
    return coverage.key_set_operations(left, right, KEY)
