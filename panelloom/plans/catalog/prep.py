"""Preprocessing fitted on training subjects only."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.models import families
from panelloom.operators import prep
from panelloom.plans import panels
from panelloom.plans.catalog.registry import FEATURES, SPLIT, query
from panelloom.sources import readings as src
from panelloom.spec import EVENTS

KEY = EVENTS.key
TRAIN = f"{SPLIT}, train AS (SELECT * FROM split_panel WHERE split = 'train')"


def _parts(spark, folder):
    panel = panels.split_panel(spark, folder)
    return panel, panel.where(F.col("split") == "train")


@query(
    "median_impute",
    f"WITH {TRAIN} SELECT subject_id, day, split, "
    + ", ".join(f"coalesce({f}, (SELECT quantile_cont({f}, 0.5) FROM train)) AS {f}" for f in FEATURES)
    + " FROM split_panel",
    " ".join(FEATURES),
)
def median_impute(spark, folder):
    panel, train = _parts(spark, folder)
    return prep.median_impute(panel, train, FEATURES).select(*KEY, "split", *FEATURES)


@query(
    "mode_impute",
    f"""WITH {TRAIN} SELECT subject_id, day, coalesce(device_flag, (
  SELECT device_flag FROM train WHERE device_flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, device_flag LIMIT 1
)) AS device_flag FROM split_panel""",
)
def mode_impute(spark, folder):
    panel, train = _parts(spark, folder)
    return prep.mode_impute(panel, train, "device_flag").select(*KEY, "device_flag")


@query(
    "standard_scale",
    f"WITH {TRAIN} SELECT subject_id, day, split, "
    + ", ".join(
        f"({f} - (SELECT avg({f}) FROM train)) / (SELECT CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END"
        f" FROM train) AS {f}"
        for f in FEATURES
    )
    + " FROM split_panel",
    " ".join(FEATURES),
)
def standard_scale(spark, folder):
    panel, train = _parts(spark, folder)
    return prep.standard_scale(panel, train, FEATURES).select(*KEY, "split", *FEATURES)


@query(
    "ordinal_encode",
    """WITH train AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size <= 25),
codes AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM train))
SELECT p_partkey, p_type, coalesce(code, -1) + 1 AS type_code FROM part LEFT JOIN codes USING (p_type)""",
)
def ordinal_encode(spark, folder):
    """Part types coded from the smaller parts; types unknown there give 0."""
    parts = src.table(spark, folder, "part").select("p_partkey", "p_type", "p_size")
    coded = prep.ordinal_encode(parts, parts.where(F.col("p_size") <= 25), "p_type", "type_code")
    return coded.select("p_partkey", "p_type", "type_code")


@query(
    "label_encode",
    f"""WITH {SPLIT} SELECT subject_id, day, label,
       CAST((SELECT count(DISTINCT p.label) FROM split_panel p WHERE p.label < s.label) AS DOUBLE) AS label_index
FROM split_panel s""",
)
def label_encode(spark, folder):
    return families.with_label_index(panels.split_panel(spark, folder), "label").select(*KEY, "label", "label_index")


@query(
    "class_weights",
    f"""WITH {TRAIN}, c AS (SELECT label, count(*) AS n FROM train GROUP BY 1)
SELECT label, n, (SELECT sum(n) FROM c) * 1.0 / ((SELECT count(*) FROM c) * n) AS balanced_weight,
       (1.0 / n) / (SELECT avg(1.0 / n) FROM c) AS normalised_weight FROM c""",
    "balanced_weight normalised_weight",
)
def class_weights(spark, folder):
    _, train = _parts(spark, folder)
    return prep.class_weights(train, "label")


@query(
    "null_guard",
    f"WITH {SPLIT} SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(*) FILTER (WHERE {f} IS NULL) AS null_rows FROM split_panel" for f in FEATURES
    )
    + ") WHERE null_rows > 0",
)
def null_guard(spark, folder):
    return prep.null_guard(panels.panel(spark, folder), FEATURES)


