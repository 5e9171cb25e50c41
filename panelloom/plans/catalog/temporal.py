"""Features from each subject's own past."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import temporal
from panelloom.operators.compare import union_conditions
from panelloom.plans import panels
from panelloom.plans.catalog.profile import ORDER_PANEL_SQL
from panelloom.plans.catalog.registry import FEATURES, PANEL, query
from panelloom.spec import EVENTS

KEY = EVENTS.key
W = "PARTITION BY subject_id ORDER BY day"
FRAMES = {
    temporal.LAG1: "lag({0}) OVER (" + W + ")",
    temporal.ROLL3: "avg({0}) OVER (" + W + " ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)",
    temporal.ROLL7: "avg({0}) OVER (" + W + " ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)",
    temporal.DEVIATION: "{0} - avg({0}) OVER (" + W + " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
}


def names(kinds, features=FEATURES):
    return [f"{f}{k}" for k in kinds for f in features]


def past_sql(source: str, kinds, features=FEATURES, prefix: str = PANEL) -> str:
    columns = ", ".join(f"{FRAMES[k].format(f)} AS {f}{k}" for k in kinds for f in features)
    return f"WITH {prefix} SELECT subject_id, day, {columns} FROM {source}"


def _past(spark, folder, kinds, block_days=None):
    featured = temporal.add_past_features(panels.panel(spark, folder), EVENTS, kinds=kinds, block_days=block_days)
    return featured.select(*KEY, *names(kinds))


def _register(key, kinds, block_days=None):
    @query(key, past_sql("panel", kinds), " ".join(names(kinds)))
    def run(spark, folder):
        return _past(spark, folder, kinds, block_days)

    return run


lag1 = _register("lag1", [temporal.LAG1])
rolling3 = _register("rolling3", [temporal.ROLL3])
rolling7 = _register("rolling7", [temporal.ROLL7])
deviation = _register("deviation", [temporal.DEVIATION])
temporal_features = _register("temporal_features", temporal.ALL_KINDS)
# The same columns with every subject cut into blocks of five days.
temporal_features_blocked = _register("temporal_features_blocked", temporal.ALL_KINDS, 5)

_ORDER_FEATURES = panels.ORDERS.features


@query(
    "order_temporal",
    past_sql("order_panel", temporal.ALL_KINDS, _ORDER_FEATURES, ORDER_PANEL_SQL),
    " ".join(names(temporal.ALL_KINDS, _ORDER_FEATURES)),
)
def order_temporal(spark, folder):
    featured = temporal.add_past_features(panels.order_panel(spark, folder), panels.ORDERS)
    return featured.select(*KEY, *names(temporal.ALL_KINDS, _ORDER_FEATURES))


def _violation_sql(source: str, name: str, features) -> str:
    """Rows of a table whose history columns differ from the past of its features."""
    checks = " UNION ALL ".join(
        f"SELECT '{name}' AS subject_table, '{f}{k}' AS feature, CAST(count(*) FILTER (WHERE abs(past_{f}{k} - {f}{k}) > 1e-9 "
        f"OR (past_{f}{k} IS NULL) <> ({f}{k} IS NULL)) AS BIGINT) AS violations FROM {source}"
        for k in temporal.ALL_KINDS
        for f in features
    )
    return checks


def _check_sql(features) -> str:
    each = [(f, k) for k in temporal.ALL_KINDS for f in features]
    past = ", ".join(f"{FRAMES[k].format(f)} AS past_{f}{k}" for f, k in each)
    same = ", ".join(f"past_{f}{k} AS {f}{k}" for f, k in each)
    leak = ", ".join(f"{f} AS {f}{k}" for f, k in each)
    return f"""WITH {PANEL}, past AS (SELECT *, {past} FROM panel),
intact AS (SELECT *, {same} FROM past), leaking AS (SELECT *, {leak} FROM past)
{_violation_sql('intact', 'intact', features)} UNION ALL {_violation_sql('leaking', 'leaking', features)}"""


def _register_check(key, features):
    @query(key, _check_sql(features))
    def run(spark, folder):
        """Rows that differ from a recomputation, for the built features and for ones that hold the present."""
        featured = temporal.add_past_features(panels.panel(spark, folder), EVENTS, features, block_days=5)
        leaking = featured.withColumns({f"{f}{k}": F.col(f) for k in temporal.ALL_KINDS for f in features})
        frames = {"intact": featured, "leaking": leaking}
        return union_conditions(
            {n: temporal.past_only_violations_by_feature(x, EVENTS, features) for n, x in frames.items()}, "subject_table"
        )

    return run


# Together all features of the panel; the SQL of the first query stays as it is.
CHECKED = {"past_only_check": FEATURES[:3], "past_only_check_rest": FEATURES[3:]}
past_only_check, past_only_check_rest = (_register_check(key, features) for key, features in CHECKED.items())
