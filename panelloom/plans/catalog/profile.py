"""Descriptive tables of the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.functions import scalars
from panelloom.operators import clean, profile, split
from panelloom.plans import panels
from panelloom.plans.catalog.registry import DAILY, FEATURES, NUMERIC, PANEL, SPLIT, band, query
from panelloom.session import cut_lineage
from panelloom.spec import EVENTS

ORDER = "(VALUES (0, 'Low'), (1, 'Medium'), (2, 'High')) AS names(label_order, label)"


def long_sql(source: str, columns: list[str], keep: str = "") -> str:
    """(keep, feature, value) of the non-null cells."""
    extra = f"{keep}, " if keep else ""
    return " UNION ALL ".join(
        f"SELECT {extra}'{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {source} WHERE {c} IS NOT NULL"
        for c in columns
    )


LONG = f"long AS ({long_sql('panel', FEATURES)})"


@query(
    "distinct_counts",
    f"""WITH {DAILY} SELECT count(*) AS rows, count(DISTINCT subject_id) AS subjects,
            count(DISTINCT (subject_id, day)) AS subject_days FROM answers""",
)
def distinct_counts(spark, folder):
    return profile.distinct_counts(panels.answers(spark, folder), EVENTS)


@query(
    "label_distribution",
    f"""WITH {PANEL} SELECT label_order, label, (SELECT count(*) FROM panel p WHERE p.label = names.label) AS n,
       (SELECT count(*) FROM panel p WHERE p.label = names.label) * 100.0 / (SELECT count(*) FROM panel) AS percent
FROM {ORDER}""",
    "percent",
)
def label_distribution(spark, folder):
    return profile.label_distribution(panels.panel(spark, folder), EVENTS)


@query(
    "label_distribution_by_split",
    f"""WITH {SPLIT}, s AS (SELECT split, count(*) AS total FROM split_panel GROUP BY 1)
SELECT s.split, label_order, names.label, count(p.label) AS n, count(p.label) * 100.0 / total AS percent
FROM s CROSS JOIN {ORDER} LEFT JOIN split_panel p ON p.split = s.split AND p.label = names.label
GROUP BY s.split, label_order, names.label, total""",
    "percent",
)
def label_distribution_by_split(spark, folder):
    return profile.label_distribution(panels.split_panel(spark, folder), EVENTS, ["split"])


_COUNTS = ", ".join(f"count(*) FILTER (WHERE label = '{x}') AS {x.lower()}" for x in ("Low", "Medium", "High"))


@query(
    "subject_profile",
    f"""WITH {PANEL} SELECT subject_id, count(*) AS n_days, min(day) AS first_day, max(day) AS last_day, {_COUNTS}
FROM panel GROUP BY 1""",
)
def subject_profile(spark, folder):
    return profile.subject_profile(panels.panel(spark, folder), EVENTS)


@query(
    "low_coverage_subjects",
    f"WITH {PANEL} SELECT subject_id, count(*) AS n_days FROM panel GROUP BY 1 HAVING count(*) < 14",
)
def low_coverage_subjects(spark, folder):
    return profile.low_coverage_subjects(panels.panel(spark, folder), EVENTS, 14)


@query(
    "split_summary",
    f"""WITH {SPLIT} SELECT split, count(DISTINCT subject_id) AS subjects, count(*) AS rows, {_COUNTS}
FROM split_panel GROUP BY 1""",
)
def split_summary(spark, folder):
    return profile.split_summary(panels.split_panel(spark, folder), EVENTS)


@query(
    "missing_by_feature",
    f"""WITH {PANEL}, n AS (SELECT count(*) AS n FROM panel) SELECT feature, missing_rows,
       missing_rows * 100.0 / (SELECT n FROM n) AS missing_percent FROM ("""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS missing_rows FROM panel" for c in FEATURES
    )
    + ")",
    "missing_percent",
)
def missing_by_feature(spark, folder):
    return profile.missing_by_feature(panels.panel(spark, folder), FEATURES)


def _group_sql(name: str, columns: tuple[str, ...]) -> str:
    empty = " + ".join(f"CAST({c} IS NULL AS INT)" for c in columns)
    full = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    k = len(columns)
    return f"""SELECT '{name}' AS feature_group, CAST({k} AS BIGINT) AS n_features,
  CAST(sum({empty}) AS BIGINT) AS missing_cells, count(*) * {k} AS total_cells,
  sum({empty}) * 100.0 / (count(*) * {k}) AS missing_percent, count(*) FILTER (WHERE {full}) AS complete_rows,
  count(*) FILTER (WHERE {full}) * 100.0 / count(*) AS complete_percent FROM panel"""


@query(
    "missing_by_group",
    f"WITH {PANEL} " + " UNION ALL ".join(_group_sql(n, c) for n, c in EVENTS.groups.items()),
    "missing_percent complete_percent",
)
def missing_by_group(spark, folder):
    return profile.missing_by_group(panels.panel(spark, folder), EVENTS.groups)


@query(
    "describe_features",
    f"""WITH {PANEL}, {LONG}
SELECT feature, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
       quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75,
       max(value) AS max FROM long GROUP BY 1""",
    "mean std min p25 p50 p75 max",
)
def describe_features(spark, folder):
    return profile.describe_features(panels.panel(spark, folder), FEATURES)


_STATS = [(f"{f}_{n}", f"{g}({f}{a})") for n, g, a in
          (("mean", "avg", ""), ("std", "stddev_samp", ""), ("median", "quantile_cont", ", 0.5")) for f in FEATURES]


@query(
    "feature_by_label",
    f"WITH {PANEL} SELECT label, {', '.join(f'{e} AS {n}' for n, e in _STATS)} FROM panel GROUP BY 1",
    " ".join(n for n, _ in _STATS),
)
def feature_by_label(spark, folder):
    return profile.feature_by_label(panels.panel(spark, folder), FEATURES, "label")


@query(
    "label_threshold_check",
    f"""WITH {PANEL} SELECT label, count(score) AS n, min(score) AS min, max(score) AS max, avg(score) AS mean,
       stddev_samp(score) AS std, quantile_cont(score, 0.5) AS median FROM panel GROUP BY 1""",
    "min max mean std median",
)
def label_threshold_check(spark, folder):
    return profile.target_by_label(panels.panel(spark, folder), "score", "label")


@query(
    "iqr_outliers",
    f"""WITH {PANEL}, {LONG},
q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT f.*, count(*) FILTER (WHERE value < lower_fence OR value > upper_fence) AS outliers, count(*) AS n,
       count(*) FILTER (WHERE value < lower_fence OR value > upper_fence) * 100.0 / count(*) AS outlier_percent
FROM f JOIN long USING (feature) GROUP BY ALL""",
    "q1 q3 iqr lower_fence upper_fence outlier_percent",
)
def iqr_outliers(spark, folder):
    return profile.iqr_outliers(panels.panel(spark, folder), FEATURES)


RANKED = """ranked AS (
  SELECT feature,
    rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry
  FROM pairs WHERE y IS NOT NULL),
spearman AS (
  SELECT feature, count(*) AS pairs, CASE WHEN count(*) >= 20 THEN corr(rx, ry) END AS rho FROM ranked GROUP BY 1)"""
_EVEN = ", ".join(f"round({c}, 9) AS {c}" for c in ["score", *FEATURES])
SPEARMAN = f"even AS (SELECT {_EVEN} FROM panel), pairs AS ({long_sql('even', FEATURES, 'score AS y')}), {RANKED}"


def _spearman(spark, folder):
    return profile.spearman(panels.panel(spark, folder), "score", FEATURES, 20)


@query("spearman", f"WITH {PANEL}, {SPEARMAN} SELECT * FROM spearman", "rho")
def spearman(spark, folder):
    return _spearman(spark, folder)


@query(
    "topk_abs_corr",
    f"WITH {PANEL}, {SPEARMAN} SELECT * FROM spearman ORDER BY abs(rho) DESC NULLS LAST, feature LIMIT 8",
    "rho",
)
def topk_abs_corr(spark, folder):
    """The eight strongest correlations: a report whose feature is the limit."""
    return profile.top_by_magnitude(_spearman(spark, folder), 8)


WEEKLY = """weekly AS (
  SELECT semester_week, count(*) AS n, avg(score) AS mean_score, stddev_samp(score) AS sd_score,
         min(day) AS week_start, max(day) AS week_end FROM panel GROUP BY 1)"""


@query("weekly_trend", f"WITH {PANEL}, {WEEKLY} SELECT * FROM weekly", "mean_score sd_score")
def weekly_trend(spark, folder):
    return profile.weekly_trend(panels.panel(spark, folder), EVENTS)


@query(
    "weekly_trend_by_label",
    f"""WITH {PANEL} SELECT semester_week, label, count(*) AS n, avg(score) AS mean_score,
       stddev_samp(score) AS sd_score, min(day) AS week_start, max(day) AS week_end FROM panel GROUP BY 1, 2""",
    "mean_score sd_score",
)
def weekly_trend_by_label(spark, folder):
    return profile.weekly_trend(panels.panel(spark, folder), EVENTS, ["semester_week", "label"])


@query(
    "weekly_band",
    f"""WITH {PANEL}, {WEEKLY},
e AS (SELECT *, mean_score + coalesce(sd_score, 0) AS u, mean_score - coalesce(sd_score, 0) AS l FROM weekly)
SELECT semester_week, mean_score, greatest(0, l) AS band_low,
       least(greatest(100, (SELECT max(u) FROM e)), u) AS band_high FROM e""",
    "mean_score band_low band_high",
)
def weekly_band(spark, folder):
    return profile.weekly_band(profile.weekly_trend(panels.panel(spark, folder), EVENTS))


@query(
    "extreme_weeks",
    f"""WITH {PANEL}, {WEEKLY}
SELECT (SELECT semester_week FROM weekly ORDER BY mean_score DESC, semester_week LIMIT 1) AS peak_week,
       (SELECT max(mean_score) FROM weekly) AS peak_mean,
       (SELECT semester_week FROM weekly ORDER BY mean_score, semester_week LIMIT 1) AS low_week,
       (SELECT min(mean_score) FROM weekly) AS low_mean""",
    "peak_mean low_mean",
)
def extreme_weeks(spark, folder):
    return profile.extreme_weeks(profile.weekly_trend(panels.panel(spark, folder), EVENTS))


@query(
    "weekday_weekend",
    f"""WITH {PANEL} SELECT CASE WHEN day_of_week >= 5 THEN 'weekend' ELSE 'weekday' END AS day_type, count(*) AS n,
       avg(score) AS mean_score, stddev_samp(score) AS sd_score, quantile_cont(score, 0.5) AS median_score
FROM panel GROUP BY 1""",
    "mean_score sd_score median_score",
)
def weekday_weekend(spark, folder):
    return profile.weekday_weekend(panels.panel(spark, folder), EVENTS)


@query(
    "histogram_fixed",
    f"""WITH {PANEL} SELECT CAST(b * 5 AS INTEGER) AS bin_start, CAST(b * 5 + 5 AS INTEGER) AS bin_end,
       (SELECT count(*) FROM panel WHERE score >= b * 5 AND score < b * 5 + 5) AS n FROM range(20) AS t(b)""",
)
def histogram_fixed(spark, folder):
    return profile.histogram_fixed(panels.panel(spark, folder), "score")


@query(
    "histogram_equal_width",
    f"""WITH {PANEL}, {LONG}, varied AS (
  SELECT feature, value FROM long UNION ALL SELECT 'constant', 7.25 FROM panel UNION ALL SELECT 'zero', 0 FROM panel),
r AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM varied GROUP BY 1),
e AS (SELECT feature, lo - pad AS lo, hi + pad AS hi FROM (
  SELECT *, CASE WHEN lo < hi THEN 0 WHEN lo = 0 THEN 0.001 ELSE abs(lo) * 0.001 END AS pad FROM r)),
b AS (SELECT feature, least(12, greatest(1, ceil(round((value - lo) * 12 / (hi - lo), 9)))) AS bin FROM varied JOIN e USING (feature))
SELECT e.feature, CAST(g.bin AS INTEGER) AS bin, count(b.bin) AS n
FROM e CROSS JOIN (SELECT unnest(range(1, 13)) AS bin) g LEFT JOIN b ON b.feature = e.feature AND b.bin = g.bin
GROUP BY ALL""",
)
def histogram_equal_width(spark, folder):
    """The features, and two that do not vary."""
    panel = panels.panel(spark, folder).withColumns({"constant": F.lit(7.25), "zero": F.lit(0.0)})
    return profile.histogram_equal_width(panel, [*FEATURES, "constant", "zero"])


@query(
    "zmeans_by_label",
    f"""WITH {PANEL} SELECT label, """
    + ", ".join(
        f"(avg({f}) - (SELECT avg({f}) FROM panel)) / (SELECT stddev_pop({f}) FROM panel) AS {f}" for f in FEATURES
    )
    + " FROM panel GROUP BY 1",
    " ".join(FEATURES),
)
def zmeans_by_label(spark, folder):
    return profile.standardised_means(panels.panel(spark, folder), FEATURES, "label")


@query(
    "dataset_summary",
    f"""WITH {PANEL}, s AS (SELECT subject_id, count(*) AS n FROM panel GROUP BY 1),
t AS (SELECT count(*) AS n, {_COUNTS} FROM panel)
SELECT 'subjects' AS metric, CAST(count(*) AS VARCHAR) AS value FROM s
UNION ALL SELECT 'rows', CAST(n AS VARCHAR) FROM t
UNION ALL SELECT 'day_range', (SELECT min(day) || ' to ' || max(day) FROM panel)
UNION ALL SELECT 'mean_days_per_subject', CAST(round(avg(n), 2) AS VARCHAR) FROM s
UNION ALL SELECT 'median_days_per_subject', CAST(round(quantile_cont(CAST(n AS DOUBLE), 0.5), 2) AS VARCHAR) FROM s
UNION ALL SELECT 'min_days_per_subject', CAST(min(n) AS VARCHAR) FROM s
UNION ALL SELECT 'max_days_per_subject', CAST(max(n) AS VARCHAR) FROM s"""
    + "".join(
        f" UNION ALL SELECT '{x}_count', CAST({x} AS VARCHAR) FROM t"
        f" UNION ALL SELECT '{x}_percent', CAST(round({x} * CAST(100 AS DOUBLE) / n, 2) AS VARCHAR) FROM t"
        for x in ("low", "medium", "high")
    ),
)
def dataset_summary(spark, folder):
    return profile.dataset_summary(panels.panel(spark, folder), EVENTS)


@query(
    "target_audit",
    f"""WITH {DAILY} SELECT count(*) AS rows, count(DISTINCT subject_id) AS subjects,
       count(DISTINCT (subject_id, day)) AS subject_days,
       (SELECT count(*) FROM (SELECT 1 FROM answers GROUP BY subject_id, day HAVING count(*) > 1))
         AS repeated_subject_days,
       CAST(count(*) FILTER (WHERE label <> {band('score')}) AS BIGINT) AS label_mismatches,
       min(score) AS target_min, max(score) AS target_max,
       count(*) FILTER (WHERE score IS NULL) AS target_missing_rows,
       count(*) FILTER (WHERE secondary IS NULL) AS secondary_missing_rows FROM answers""",
    "target_min target_max",
)
def target_audit(spark, folder):
    return profile.target_audit(panels.answers(spark, folder), EVENTS)


_MISSING = [*FEATURES, "score", "secondary", "device_score", "device_flag"]


def _audit_sql(stage: str, source: str) -> str:
    metric = lambda name, value: f"SELECT '{stage}' AS stage, '{name}' AS metric, CAST({value} AS VARCHAR) AS value"
    full = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)
    empty = " + ".join(f"CAST({c} IS NULL AS INT)" for c in FEATURES)
    repeated = f"(SELECT count(*) AS n FROM {source} GROUP BY subject_id, day HAVING count(*) > 1)"
    lines = [
        metric("rows", "count(*)") + f" FROM {source}",
        metric("subjects", "count(DISTINCT subject_id)") + f" FROM {source}",
        metric("subject_days", "count(DISTINCT (subject_id, day))") + f" FROM {source}",
        metric("day_min", "min(day)") + f" FROM {source}",
        metric("day_max", "max(day)") + f" FROM {source}",
        metric("surplus_rows", "count(*) - count(DISTINCT (subject_id, day))") + f" FROM {source}",
        metric("repeated_keys", "count(*)") + f" FROM {repeated}",
        metric("rows_of_repeated_keys", "coalesce(sum(n), 0)") + f" FROM {repeated}",
        metric("complete_rows", f"count(*) FILTER (WHERE {full})") + f" FROM {source}",
        metric("missing_cells", f"sum({empty})") + f" FROM {source}",
        metric("total_cells", f"count(*) * {len(FEATURES)}") + f" FROM {source}",
        metric("missing_percent", f"round(sum({empty}) * CAST(100 AS DOUBLE) / (count(*) * {len(FEATURES)}), 2)")
        + f" FROM {source}",
        metric("complete_percent", f"round(count(*) FILTER (WHERE {full}) * CAST(100 AS DOUBLE) / count(*), 2)")
        + f" FROM {source}",
    ]
    lines += [metric(f"label_{x.lower()}", f"count(*) FILTER (WHERE label = '{x}')") + f" FROM {source}"
              for x in ("Low", "Medium", "High")]
    lines += [metric(f"missing_{c}", f"count(*) FILTER (WHERE {c} IS NULL)") + f" FROM {source}" for c in _MISSING]
    return " UNION ALL ".join(lines)


_DUPLICATES = """SELECT 'duplicates' AS stage, metric, CAST(value AS VARCHAR) AS value FROM (
  SELECT CAST(sum(n) AS BIGINT) AS rows_of_repeated_keys, CAST(sum(n - 1) AS BIGINT) AS surplus_rows,
         count(*) AS repeated_keys, count(*) FILTER (WHERE s) AS keys_with_score_conflict,
         count(*) FILTER (WHERE l) AS keys_with_label_conflict
  FROM (SELECT count(*) AS n, min(score) <> max(score) AS s, min(label) <> max(label) AS l
        FROM subject_day_rows GROUP BY subject_id, day HAVING count(*) > 1)
) UNPIVOT (value FOR metric IN (rows_of_repeated_keys, surplus_rows, repeated_keys, keys_with_score_conflict,
                                keys_with_label_conflict))"""

_MODEL = f"""SELECT 'model' AS stage, split || '_' || name AS metric, CAST(value AS VARCHAR) AS value FROM (
  SELECT split, count(DISTINCT subject_id) AS subjects, count(*) AS rows, {_COUNTS} FROM split_panel GROUP BY 1
) UNPIVOT (value FOR name IN (subjects, rows, low, medium, high))"""


@query(
    "stage_audit",
    f"""WITH {SPLIT} {_audit_sql('build', 'subject_day_rows')} UNION ALL {_audit_sql('clean', 'panel')}
UNION ALL {_DUPLICATES} UNION ALL {_MODEL}""",
)
def stage_audit(spark, folder):
    """The stages one after the other, each table stored once; events are read in two passes, targets and days."""
    rows = cut_lineage(panels.rows(spark, folder))
    panel = cut_lineage(scalars.with_calendar(clean.resolve_duplicates(rows, EVENTS), EVENTS.day))
    model = split.assign_split(panel, split.subject_split(panel, EVENTS), EVENTS)
    return profile.stage_audit(rows, panel, model, EVENTS)


ORDER_PANEL_SQL = """
lines AS (
  SELECT CAST(o_custkey AS VARCHAR) AS subject_id, CAST(o_orderdate AS DATE) AS day, l.*,
         date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > 90 AS late
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey),
targets AS (
  SELECT CAST(o_custkey AS VARCHAR) AS subject_id, CAST(o_orderdate AS DATE) AS day,
         avg(o_totalprice) AS score, avg(length(o_orderpriority)) AS secondary FROM orders GROUP BY 1, 2),
features AS (
  SELECT subject_id, day, avg(l_quantity) AS quantity_mean, sum(l_extendedprice) AS price_sum,
         stddev_samp(l_discount) AS discount_std,
         CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS returned_lines,
         CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) AS accepted_lines,
         CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS DOUBLE) AS neutral_lines,
         avg(l_tax) AS device_score, bool_or(late) AS device_flag
  FROM lines GROUP BY 1, 2),
order_panel AS (
  SELECT subject_id, day, score,
         CASE WHEN score <= 100000 THEN 'Low' WHEN score <= 200000 THEN 'Medium' ELSE 'High' END AS label,
         secondary, quantity_mean, price_sum, discount_std, returned_lines, accepted_lines, neutral_lines,
         device_score, device_flag FROM targets LEFT JOIN features USING (subject_id, day))"""


@query(
    "order_panel",
    f"WITH {ORDER_PANEL_SQL} SELECT * FROM order_panel",
    "score secondary quantity_mean price_sum discount_std returned_lines accepted_lines neutral_lines device_score",
)
def order_panel(spark, folder):
    """The larger panel: customers on their order days, features from lines."""
    return panels.order_panel(spark, folder)


_ORDER_FEATURES = panels.ORDERS.features


_ROUNDED = ", ".join(f"round({f}, 9) AS {f}" for f in _ORDER_FEATURES)


@query(
    "order_spearman",
    f"""WITH {ORDER_PANEL_SQL}, even AS (SELECT score, {_ROUNDED} FROM order_panel),
pairs AS ({long_sql('even', _ORDER_FEATURES, 'score AS y')}),
{RANKED} SELECT * FROM spearman""",
    "rho",
)
def order_spearman(spark, folder):
    """Features are rounded first: deviations that tie on paper then tie in ranks."""
    panel = panels.order_panel(spark, folder)
    even = panel.select("score", *[F.round(f, 9).alias(f) for f in _ORDER_FEATURES])
    return profile.spearman(even, "score", _ORDER_FEATURES, 20, digits=None)


@query(
    "order_describe",
    f"""WITH {ORDER_PANEL_SQL}, long AS ({long_sql('order_panel', _ORDER_FEATURES)})
SELECT feature, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
       quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75,
       max(value) AS max FROM long GROUP BY 1""",
    "mean std min p25 p50 p75 max",
)
def order_describe(spark, folder):
    return profile.describe_features(panels.order_panel(spark, folder), _ORDER_FEATURES)
