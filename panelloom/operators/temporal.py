"""Features from a subject's own past, the current row always left out.

Frames count observations, not days: a gap in the calendar does not matter.
The key (subject, day) must be unique; then a subject has at most one row per
calendar day, which bounds a window partition by the length of the calendar
however many rows the table has, and all features share one shuffle and sort.

``block_days`` is for panels keyed by something finer than days: each subject
is cut into blocks of time and every block is given what it needs of the past.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from panelloom.spec import PanelSpec

LAG1, ROLL3, ROLL7 = "_lag1", "_rolling3_mean", "_rolling7_mean"
DEVIATION = "_deviation_from_past_mean"
ROLLING = {ROLL3: 3, ROLL7: 7}
ALL_KINDS = (LAG1, ROLL3, ROLL7, DEVIATION)


def _past(spec: PanelSpec) -> WindowSpec:
    return Window.partitionBy(spec.subject).orderBy(spec.day)


def _frame_column(kind: str, name: str, past: WindowSpec) -> Column:
    if kind == LAG1:
        return F.lag(name, 1).over(past)
    if kind in ROLLING:
        return F.avg(name).over(past.rowsBetween(-ROLLING[kind], -1))
    if kind == DEVIATION:
        return F.col(name) - F.avg(name).over(past.rowsBetween(Window.unboundedPreceding, -1))
    raise ValueError(f"unknown temporal feature {kind!r}")


def add_past_features(
    panel: DataFrame,
    spec: PanelSpec,
    features: Sequence[str] | None = None,
    kinds: Sequence[str] = ALL_KINDS,
    block_days: int | None = None,
) -> DataFrame:
    """Add ``<feature><kind>`` columns for every feature and kind."""
    features = list(features if features is not None else spec.features)
    if block_days is not None:
        return _by_blocks(panel, spec, features, kinds, block_days)
    past = _past(spec)
    return panel.withColumns({f"{f}{k}": _frame_column(k, f, past) for k in kinds for f in features})


def previous_value(panel: DataFrame, spec: PanelSpec, column: str, out: str) -> DataFrame:
    """Value at the subject's previous observation."""
    return panel.withColumn(out, F.lag(column, 1).over(_past(spec)))


def _by_blocks(
    panel: DataFrame, spec: PanelSpec, features: list[str], kinds: Sequence[str], block_days: int
) -> DataFrame:
    """The same columns with windows over (subject, block of time).

    Row frames reach back at most seven observations, so each block borrows the
    last seven rows before it.  The expanding mean needs sums only: they are
    taken per block and accumulated over the blocks of a subject.
    """
    reach = max([ROLLING.get(k, 1) for k in kinds if k != DEVIATION], default=0)
    subject, day = spec.subject, spec.day
    blocked = panel.withColumn("_block", F.floor(F.unix_timestamp(F.col(day)) / (86400 * block_days)))
    blocks = Window.partitionBy(subject).orderBy("_block")
    ahead = blocks.rowsBetween(Window.unboundedPreceding, -1)

    rows = blocked.withColumn("_borrowed", F.lit(False))
    if reach:
        # The last rows of each block. A block is never empty, so the tails of
        # the ``reach`` blocks before it hold everything it may look back to.
        latest = Window.partitionBy(subject, "_block").orderBy(F.col(day).desc())
        row = F.struct(day, *features)
        tails = (
            blocked.select(subject, day, "_block", *features)
            .withColumn("_n", F.row_number().over(latest))
            .where(F.col("_n") <= reach)
            .groupBy(subject, "_block")
            .agg(F.array_sort(F.collect_list(row)).alias("_tail"))
            .withColumn("_before", F.flatten(F.collect_list("_tail").over(blocks.rowsBetween(-reach, -1))))
            .select(subject, "_block", F.explode(F.slice(F.reverse("_before"), 1, reach)).alias("_row"))
            .select(subject, "_block", "_row.*", F.lit(True).alias("_borrowed"))
        )
        rows = rows.unionByName(tails, allowMissingColumns=True)

    local = Window.partitionBy(subject, "_block").orderBy(day)
    columns = {f"{f}{k}": _frame_column(k, f, local) for k in kinds if k != DEVIATION for f in features}
    carried: list[str] = []
    if DEVIATION in kinds:
        sums = blocked.groupBy(subject, "_block").agg(
            *[F.coalesce(F.sum(f), F.lit(0.0)).alias(f"_s_{f}") for f in features],
            *[F.count(f).alias(f"_c_{f}") for f in features],
        )
        carried = [f"{p}_{f}" for p in ("_s", "_c") for f in features]
        sums = sums.select(
            subject, "_block", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in carried]
        )
        rows = rows.join(sums, [subject, "_block"])
        own = F.col("_borrowed") == F.lit(False)
        earlier = local.rowsBetween(Window.unboundedPreceding, -1)
        for f in features:
            value = F.when(own, F.col(f))
            total = F.col(f"_s_{f}") + F.coalesce(F.sum(value).over(earlier), F.lit(0.0))
            count = F.col(f"_c_{f}") + F.count(value).over(earlier)
            columns[f"{f}{DEVIATION}"] = F.col(f) - F.try_divide(total, count)
    return rows.withColumns(columns).where(~F.col("_borrowed")).drop("_block", "_borrowed", *carried)


def past_only_violations_by_feature(featured: DataFrame, spec: PanelSpec, features: Sequence[str]) -> DataFrame:
    """(feature, violations): rows whose stored past feature differs from a recomputation.

    Rows ahead of a subject's first observation have no past, so any value in
    their history columns is a leak as well.
    """
    past = _past(spec)
    kinds = [k for k in ALL_KINDS if all(f"{f}{k}" in featured.columns for f in features)]
    names = [f"{f}{k}" for k in kinds for f in features]
    checks = {
        f"_x_{f}{k}": (
            F.abs(_frame_column(k, f, past) - F.col(f"{f}{k}")) > 1e-9
        ).eqNullSafe(True)
        | (_frame_column(k, f, past).isNull() != F.col(f"{f}{k}").isNull())
        for k in kinds
        for f in features
    }
    marked = featured.withColumns(checks).agg(*[F.count_if(F.col(f"_x_{n}")).alias(n) for n in names])
    return marked.unpivot([], names, "feature", "violations")


def past_only_violations(featured: DataFrame, spec: PanelSpec, features: Sequence[str]) -> DataFrame:
    """Violations of all features together, as one row."""
    return past_only_violations_by_feature(featured, spec, features).agg(F.sum("violations").alias("violations"))
