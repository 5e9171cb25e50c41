"""Scans, scalar functions, daily aggregates, joins and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.functions import scalars
from panelloom.operators import clean, compare, daily
from panelloom.plans import panels
from panelloom.plans.catalog.registry import (
    COLUMNS,
    DAILY,
    NUMERIC,
    PANEL,
    READINGS,
    ROWS,
    band,
    query,
)
from panelloom.sources import readings as src
from panelloom.sources import tables
from panelloom.spec import EVENTS

KEY = EVENTS.key


@query(
    "scan_panel",
    f"WITH {READINGS} SELECT subject_id, day, value AS score, k AS secondary, {band('value')} AS label FROM readings",
    "score secondary",
)
def scan_panel(spark, folder):
    """Load a table and bring its role columns to the panel types."""
    loaded = src.table(spark, folder, "events").select(
        F.col("user_id").alias("subject_id"),
        F.col("ts").alias("day"),
        F.col("value").alias("score"),
        F.get_json_object("props", "$.k").alias("secondary"),
    )
    typed = tables.with_panel_types(loaded, EVENTS)
    return typed.withColumn("label", scalars.band(F.col("score")))


@query(
    "unix_to_day",
    """SELECT event_id, CASE WHEN event_type NOT IN ('error', 'signup')
              THEN CAST(make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS DATE) END AS day FROM events""",
)
def unix_to_day(spark, folder):
    """Unix seconds kept as text; one event type carries unreadable text, one milliseconds."""
    events = src.table(spark, folder, "events")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")
    text = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(seconds)
    text = F.when(F.col("event_type") == "signup", F.concat(seconds, F.lit("000"))).otherwise(text)
    return events.select("event_id", scalars.unix_day(text).alias("day"))


@query(
    "lenient_date",
    "SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) END AS day FROM events",
)
def lenient_date(spark, folder):
    """Timestamps in two notations per event type, one type unreadable."""
    notations = {
        "view": ("yyyy-MM-dd'T'HH:mm:ss'Z'", "MMM d yyyy HH:mm"),
        "click": ("yyyy-MM-dd HH:mm:ss", "yyyyMMdd"),
        "signup": ("MM/dd/yyyy HH:mm:ss", "M/d/yyyy h:mm a"),
        "purchase": ("yyyy-MM-dd", "d MMM yyyy"),
    }
    text = F.lit("n/a")
    for kind, (even, odd) in notations.items():
        shown = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", even)).otherwise(F.date_format("ts", odd))
        text = F.when(F.col("event_type") == kind, shown).otherwise(text)
    day = scalars.lenient_day(F.col("text"))
    return src.table(spark, folder, "events").select("event_id", text.alias("text")).select("event_id", day.alias("day"))


@query(
    "lenient_number",
    """SELECT o_orderkey, try_cast(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority
              ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE) AS number FROM orders""",
    "number",
)
def lenient_number(spark, folder):
    orders = src.table(spark, folder, "orders")
    text = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(F.col("o_custkey").cast("string"))
    return orders.select("o_orderkey", scalars.number(text).alias("number"))


@query("band_label", f"SELECT event_id, value, {band('value')} AS label FROM events", "value")
def band_label(spark, folder):
    return src.table(spark, folder, "events").select(
        "event_id", "value", scalars.band(F.col("value")).alias("label")
    )


@query(
    "calendar_features",
    f"WITH {PANEL} SELECT subject_id, day, semester_week, day_of_week, is_weekend FROM panel",
)
def calendar_features(spark, folder):
    return panels.panel(spark, folder).select(*KEY, "semester_week", "day_of_week", "is_weekend")


def _daily(spark, folder, modality):
    return daily.daily_modality(panels.readings(spark, folder), KEY, src.EVENT_MEASURES, modality)


@query("daily_mean", f"WITH {DAILY} SELECT * FROM sleep", "sleep_score deep_sleep_minutes")
def daily_mean(spark, folder):
    return _daily(spark, folder, "sleep")


@query("daily_sum", f"WITH {DAILY} SELECT subject_id, day, total_steps FROM movement", "total_steps")
def daily_sum(spark, folder):
    return _daily(spark, folder, "movement").select(*KEY, "total_steps")


@query(
    "activity_pivot",
    f"WITH {DAILY} SELECT * FROM activity",
    "sedentary_minutes lightly_active_minutes moderately_active_minutes very_active_minutes",
)
def activity_pivot(spark, folder):
    return _daily(spark, folder, "activity")


@query(
    "daily_mean_std", f"WITH {DAILY} SELECT subject_id, day, avg_oxygen, std_oxygen FROM oxygen", "avg_oxygen std_oxygen"
)
def daily_mean_std(spark, folder):
    return _daily(spark, folder, "oxygen").select(*KEY, "avg_oxygen", "std_oxygen")


@query(
    "daily_flag_any", f"WITH {DAILY} SELECT subject_id, day, device_score, device_flag FROM oxygen", "device_score"
)
def daily_flag_any(spark, folder):
    return _daily(spark, folder, "oxygen").select(*KEY, "device_score", "device_flag")


@query("subject_day_build", f"WITH {ROWS} SELECT * FROM subject_day_rows", " ".join(NUMERIC))
def subject_day_build(spark, folder):
    """Target rows left-joined with all daily columns."""
    return panels.rows(spark, folder)


@query("subject_day_chain", f"WITH {ROWS} SELECT * FROM subject_day_rows", " ".join(NUMERIC))
def subject_day_chain(spark, folder):
    """The same table built as a chain of joins, one per kind of reading."""
    readings = panels.readings(spark, folder)
    targets = daily.target_rows(readings, EVENTS, "target", "value", "k")
    sides = [daily.daily_modality(readings, KEY, src.EVENT_MEASURES, m) for m in src.EVENT_WEARABLES]
    return daily.enrich(targets, sides, KEY).select(*COLUMNS)


@query("resolve_duplicates", f"WITH {PANEL} SELECT {', '.join(COLUMNS)} FROM panel", " ".join(NUMERIC))
def resolve_duplicates(spark, folder):
    return clean.resolve_duplicates(panels.rows(spark, folder), EVENTS)


@query("clean_panel", f"WITH {PANEL} SELECT {', '.join(COLUMNS)} FROM panel", " ".join(NUMERIC))
def clean_panel(spark, folder):
    """Build and cleaning in one grouping."""
    return panels.panel(spark, folder).select(*COLUMNS)


@query(
    "duplicate_conflicts",
    f"""WITH {ROWS}
SELECT subject_id, day, count(*) AS n_rows,
       array_to_string(list_sort(list_distinct(list(label))), '; ') AS label_values,
       count(DISTINCT score) > 1 AS value_conflict, count(DISTINCT label) > 1 AS label_conflict,
       array_to_string(list_sort(list(score)), '; ') AS score_values,
       array_to_string(list_sort(list(secondary)), '; ') AS secondary_values
FROM subject_day_rows GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_conflicts(spark, folder):
    return clean.duplicate_conflicts(panels.answers(spark, folder), EVENTS)


@query(
    "repeated_values",
    f"""WITH {DAILY}
SELECT subject_id, day, score AS value, count(*) AS n FROM answers
WHERE (subject_id, day) IN (SELECT (subject_id, day) FROM answers GROUP BY subject_id, day HAVING count(*) > 1)
GROUP BY 1, 2, 3""",
    "value",
)
def repeated_values(spark, folder):
    return clean.repeated_values(panels.answers(spark, folder), KEY, "score")


@query(
    "duplicate_summary",
    f"""WITH {DAILY}, g AS (
  SELECT count(*) AS n, min(score) <> max(score) AS s, min(label) <> max(label) AS l
  FROM answers GROUP BY subject_id, day HAVING count(*) > 1)
SELECT CAST(sum(n) AS BIGINT) AS rows_of_repeated_keys, CAST(sum(n - 1) AS BIGINT) AS surplus_rows,
       count(*) AS repeated_keys, count(*) FILTER (WHERE s) AS keys_with_score_conflict,
       count(*) FILTER (WHERE l) AS keys_with_label_conflict FROM g""",
)
def duplicate_summary(spark, folder):
    return clean.duplicate_summary(panels.answers(spark, folder), EVENTS)


@query(
    "mark_duplicates",
    f"""WITH {DAILY}
SELECT event_id, subject_id, day, count(*) OVER (PARTITION BY subject_id, day) > 1 AS in_repeated_key,
       row_number() OVER (PARTITION BY subject_id, day ORDER BY event_id) > 1 AS is_surplus FROM answers""",
)
def mark_duplicates(spark, folder):
    marked = clean.mark_duplicates(panels.answers(spark, folder), KEY, "event_id")
    return marked.select("event_id", *KEY, "in_repeated_key", "is_surplus")


# Two versions of the answers: all of them, and those below the highest band
# limit with rounded scores.
_OLD = "old AS (SELECT subject_id, day, floor(score) AS score, secondary FROM answers WHERE score <= 38)"


def _versions(spark, folder):
    new = panels.answers(spark, folder)
    old = new.where(F.col("score") <= 38).withColumn("score", F.floor("score").cast("double"))
    return old, new


@query(
    "table_compare",
    f"""WITH {DAILY}, {_OLD},
o AS (SELECT subject_id, day, count(*) AS n, list_sort(list(score)) AS s, list_sort(list(secondary)) AS a
      FROM old GROUP BY 1, 2),
w AS (SELECT subject_id, day, count(*) AS n, list_sort(list(score)) AS s, list_sort(list(secondary)) AS a
      FROM answers GROUP BY 1, 2)
SELECT CAST(sum(coalesce(o.n, 0)) AS BIGINT) AS old_rows, CAST(sum(coalesce(w.n, 0)) AS BIGINT) AS new_rows,
       count(o.n) AS old_keys, count(w.n) AS new_keys, count(*) FILTER (WHERE o.n IS NOT NULL AND w.n IS NOT NULL)
       AS common_keys, count(*) FILTER (WHERE w.n IS NULL) AS old_only_keys,
       count(*) FILTER (WHERE o.n IS NULL) AS new_only_keys,
       count(*) FILTER (WHERE o.n <> w.n) AS different_row_counts,
       count(*) FILTER (WHERE o.s <> w.s) AS different_score,
       count(*) FILTER (WHERE o.a <> w.a) AS different_secondary
FROM o FULL JOIN w ON o.subject_id = w.subject_id AND o.day = w.day""",
)
def table_compare(spark, folder):
    old, new = _versions(spark, folder)
    return compare.table_compare(old, new, KEY, ["score", "secondary"])


@query(
    "label_mismatch",
    f"""WITH {DAILY}
SELECT count(*) AS rows, count(*) FILTER (WHERE label <> {band('floor(score)')}) AS mismatches FROM answers""",
)
def label_mismatch(spark, folder):
    from panelloom.operators import validate

    stored = panels.answers(spark, folder).withColumn("score", F.floor("score").cast("double"))
    return validate.label_mismatch(stored, EVENTS, "label")
