"""Registration of queries and the SQL building blocks their checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelloom.functions.scalars import rounded
from panelloom.session import prepare
from panelloom.spec import EVENTS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


# Two engines add doubles up in different orders, so a mean that ends in an
# exact half could be rounded either way. Both sides are nudged off the half.
NUDGE = "1e-9"


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable[[Query], Query]:
    """Register a query; ``doubles`` names the SQL columns to round like Spark's."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(function(prepare(spark), folder), 6, float(NUDGE))

        run.__name__ = name
        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = checked(sql, doubles.split())
        return function

    return register


def checked(body: str, doubles: list[str]) -> str:
    if not doubles:
        return body.strip()
    replaced = ", ".join(f"round({c} + {NUDGE}, 6) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({replaced}) FROM ({body.strip()}) AS result"


FEATURES = EVENTS.features
NUMERIC = ["score", "secondary", *FEATURES, "device_score"]

BAND = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} <= 17 THEN 'Low' WHEN {0} <= 38 THEN 'Medium' ELSE 'High' END"


def band(column: str) -> str:
    return BAND.format(column)


READINGS = """
readings AS (
  SELECT CAST(user_id AS VARCHAR) AS subject_id, CAST(ts AS DATE) AS day, event_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events
)"""

LEVEL = """CASE CAST(floor(k / 25) AS BIGINT) WHEN 0 THEN 'SEDENTARY' WHEN 1 THEN 'LIGHTLY_ACTIVE'
  WHEN 2 THEN 'MODERATELY_ACTIVE' WHEN 3 THEN 'VERY_ACTIVE' END"""

MODALITY = """CASE event_type WHEN 'purchase' THEN 'target' WHEN 'view' THEN 'sleep'
  WHEN 'click' THEN 'movement' WHEN 'signup' THEN 'activity' WHEN 'error' THEN 'oxygen' END"""

DAILY = (
    READINGS
    + f""",
answers AS (
  SELECT subject_id, day, event_id, value AS score, k AS secondary, {band('value')} AS label
  FROM readings WHERE event_type = 'purchase'
),
sleep AS (
  SELECT subject_id, day, avg(value) AS sleep_score, avg(k) AS deep_sleep_minutes
  FROM readings WHERE event_type = 'view' GROUP BY 1, 2
),
movement AS (
  SELECT subject_id, day, coalesce(sum(value), 0) AS total_steps, avg(value) AS avg_rmssd,
         avg(k) AS avg_low_frequency, avg(value * k / 100) AS avg_high_frequency
  FROM readings WHERE event_type = 'click' GROUP BY 1, 2
),
levels AS (SELECT subject_id, day, {LEVEL} AS level FROM readings WHERE event_type = 'signup'),
activity AS (
  SELECT subject_id, day,
         CAST(count(*) FILTER (WHERE level = 'SEDENTARY') AS DOUBLE) AS sedentary_minutes,
         CAST(count(*) FILTER (WHERE level = 'LIGHTLY_ACTIVE') AS DOUBLE) AS lightly_active_minutes,
         CAST(count(*) FILTER (WHERE level = 'MODERATELY_ACTIVE') AS DOUBLE) AS moderately_active_minutes,
         CAST(count(*) FILTER (WHERE level = 'VERY_ACTIVE') AS DOUBLE) AS very_active_minutes
  FROM levels WHERE level IS NOT NULL GROUP BY 1, 2
),
oxygen AS (
  SELECT subject_id, day, avg(value) AS avg_oxygen, stddev_samp(value) AS std_oxygen,
         avg(k) AS device_score, bool_or(k >= 90) AS device_flag
  FROM readings WHERE event_type = 'error' GROUP BY 1, 2
)"""
)

COLUMNS = ["subject_id", "day", "score", "label", "secondary", *FEATURES, "device_score", "device_flag"]

ROWS = (
    DAILY
    + f""",
subject_day_rows AS (
  SELECT {', '.join(COLUMNS)}
  FROM answers
  LEFT JOIN sleep USING (subject_id, day) LEFT JOIN movement USING (subject_id, day)
  LEFT JOIN activity USING (subject_id, day) LEFT JOIN oxygen USING (subject_id, day)
)"""
)

_AVERAGES = ", ".join(f"avg({c}) AS {c}" for c in NUMERIC)

PANEL = (
    ROWS
    + f""",
resolved AS (
  SELECT subject_id, day, {_AVERAGES}, bool_or(device_flag) AS device_flag
  FROM subject_day_rows GROUP BY 1, 2
),
panel AS (
  SELECT *, {band('score')} AS label,
         CAST(floor(date_diff('day', (SELECT min(day) FROM resolved), day) / 7) + 1 AS INTEGER) AS semester_week,
         CAST(isodow(day) - 1 AS INTEGER) AS day_of_week,
         CAST(isodow(day) >= 6 AS INTEGER) AS is_weekend
  FROM resolved
)"""
)

SPLIT = (
    PANEL
    + """,
subjects AS (
  SELECT subject_id, count(*) AS n_rows, count(*) FILTER (WHERE label = 'Low') AS low,
         count(*) FILTER (WHERE label = 'Medium') AS medium, count(*) FILTER (WHERE label = 'High') AS high
  FROM panel GROUP BY 1
),
assignment AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('49:' || subject_id), subject_id) - 1
                      < ceil(0.25 * (SELECT count(*) FROM subjects)) THEN 'test' ELSE 'train' END AS split
  FROM subjects
),
split_panel AS (SELECT panel.*, split FROM panel JOIN assignment USING (subject_id))"""
)

# Test rows with the previous observation's label as prediction, and the
# majority label of the training rows where there is none.
PREDICTIONS = (
    SPLIT
    + """,
majority AS (
  SELECT label FROM split_panel WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1
),
predictions AS (
  SELECT * FROM (
    SELECT subject_id, day, label, split, is_weekend,
           coalesce(lag(label) OVER (PARTITION BY subject_id ORDER BY day), (SELECT label FROM majority)) AS prediction
    FROM split_panel
  ) WHERE split = 'test'
)"""
)

LABEL_LIST = "(VALUES ('Low'), ('Medium'), ('High')) AS names(label)"


def metric_sql(source: str, by: str = "") -> str:
    """Macro and per-label metrics of a (label, prediction) relation, long way round."""
    keys = f"{by}, " if by else ""
    grid = f"(SELECT DISTINCT {by} FROM {source})" if by else "(SELECT 1)"
    group = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {keys}
       sum(hit) * 1.0 / sum(actual) AS accuracy,
       avg(CASE WHEN predicted = 0 THEN 0 ELSE hit * 1.0 / predicted END) FILTER (WHERE actual + predicted > 0)
         AS macro_precision,
       avg(CASE WHEN actual = 0 THEN 0 ELSE hit * 1.0 / actual END) FILTER (WHERE actual + predicted > 0)
         AS macro_recall,
       avg(2.0 * hit / (actual + predicted)) FILTER (WHERE actual + predicted > 0) AS macro_f1,
       coalesce(max(2.0 * hit / nullif(actual + predicted, 0)) FILTER (WHERE label = 'Low'), 0) AS low_f1,
       coalesce(max(2.0 * hit / nullif(actual + predicted, 0)) FILTER (WHERE label = 'Medium'), 0) AS medium_f1,
       coalesce(max(2.0 * hit / nullif(actual + predicted, 0)) FILTER (WHERE label = 'High'), 0) AS high_f1,
       CAST(max(actual) FILTER (WHERE label = 'Low') AS BIGINT) AS low_support,
       CAST(max(actual) FILTER (WHERE label = 'Medium') AS BIGINT) AS medium_support,
       CAST(max(actual) FILTER (WHERE label = 'High') AS BIGINT) AS high_support
FROM (
  SELECT {keys.replace(by, 'g.' + by) if by else ''} names.label,
         coalesce(sum(CAST(p.label = names.label AND p.prediction = names.label AS INT)), 0) AS hit,
         coalesce(sum(CAST(p.label = names.label AS INT)), 0) AS actual,
         coalesce(sum(CAST(p.prediction = names.label AS INT)), 0) AS predicted
  FROM {grid} AS g CROSS JOIN {LABEL_LIST}
  JOIN {source} AS p ON {f'p.{by} = g.{by}' if by else 'true'}
  GROUP BY {f'g.{by}, ' if by else ''} names.label
) {group}"""


METRICS = "accuracy macro_precision macro_recall macro_f1 low_f1 medium_f1 high_f1"
