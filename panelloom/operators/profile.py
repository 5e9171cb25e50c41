"""Descriptive tables of a subject-day panel.

Wide one-pass aggregates followed by ``unpivot`` of a single row, rather than
one job per feature.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions import ordering, scalars
from panelloom.functions.scalars import percent
from panelloom.session import cut_lineage
from panelloom.spec import LABELS, PanelSpec


def label_table(frame: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """The fixed label order as rows (label_order, label)."""
    entries = F.array(*[F.lit(x) for x in labels])
    return frame.sparkSession.range(1).select(F.posexplode(entries).alias("label_order", "label"))


def label_counts(label: str, labels: Sequence[str] = LABELS) -> list[Column]:
    return [F.count_if(F.col(label) == name).alias(name.lower()) for name in labels]


def distinct_counts(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    key = F.when(F.col(spec.subject).isNotNull() & F.col(spec.day).isNotNull(), F.struct(*spec.key))
    return panel.agg(
        F.count("*").alias("rows"),
        F.count_distinct(spec.subject).alias("subjects"),
        F.count_distinct(key).alias("subject_days"),
    )


def label_distribution(panel: DataFrame, spec: PanelSpec, by: Sequence[str] = ()) -> DataFrame:
    """Count and percent per label in fixed order, absent labels as zero."""
    wide = panel.groupBy(*by).agg(F.count("*").alias("_rows"), *label_counts(spec.label))
    names = [x.lower() for x in LABELS]
    order = F.element_at(
        F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]), F.col("_label")
    )
    return wide.unpivot([*by, "_rows"], names, "_label", "n").select(
        *by,
        order.alias("label_order"),
        F.initcap("_label").alias("label"),
        "n",
        percent(F.col("n"), F.col("_rows")).alias("percent"),
    )


def subject_profile(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    return panel.groupBy(spec.subject).agg(
        F.count("*").alias("n_days"),
        F.min(spec.day).alias("first_day"),
        F.max(spec.day).alias("last_day"),
        *label_counts(spec.label),
    )


def low_coverage_subjects(panel: DataFrame, spec: PanelSpec, fewer_than: int) -> DataFrame:
    return (
        panel.groupBy(spec.subject).agg(F.count("*").alias("n_days")).where(F.col("n_days") < fewer_than)
    )


def split_summary(panel: DataFrame, spec: PanelSpec, split: str = "split") -> DataFrame:
    """Subjects, rows and labels per split, through one row per subject."""
    per_subject = panel.groupBy(split, spec.subject).agg(F.count("*").alias("n"), *label_counts(spec.label))
    return per_subject.groupBy(split).agg(
        F.count("*").alias("subjects"),
        F.sum("n").alias("rows"),
        *[F.sum(x.lower()).alias(x.lower()) for x in LABELS],
    )


def missing_by_feature(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    counts = panel.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(f).isNull()).alias(f) for f in features]
    )
    return counts.unpivot(["_rows"], list(features), "feature", "missing_rows").select(
        "feature", "missing_rows", percent(F.col("missing_rows"), F.col("_rows")).alias("missing_percent")
    )


def _all_present(features: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])


def _empty_cells(features: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f).isNull().cast("bigint") for f in features])


def missing_by_group(panel: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    columns = [F.count("*").alias("_rows")]
    for name, features in groups.items():
        columns.append(
            F.struct(
                F.lit(len(features)).cast("bigint").alias("n_features"),
                F.coalesce(F.sum(_empty_cells(features)), F.lit(0)).alias("missing_cells"),
                F.count_if(_all_present(features)).alias("complete_rows"),
            ).alias(name)
        )
    rows = panel.agg(*columns).unpivot(["_rows"], list(groups), "feature_group", "s").select(
        "feature_group", "_rows", "s.*"
    )
    total = F.col("_rows") * F.col("n_features")
    return rows.select(
        "feature_group",
        "n_features",
        "missing_cells",
        total.alias("total_cells"),
        percent(F.col("missing_cells"), total).alias("missing_percent"),
        "complete_rows",
        percent(F.col("complete_rows"), F.col("_rows")).alias("complete_percent"),
    )


QUARTILES = {0.25: "p25", 0.5: "p50", 0.75: "p75"}


def describe_features(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles, maximum."""
    moments = (
        ordering.melt(panel, features)
        .groupBy("feature")
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    quarters = ordering.quantile_columns(ordering.quantiles(panel, features, list(QUARTILES)), QUARTILES)
    return moments.join(quarters, "feature", "left")


def feature_by_label(panel: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One row per label with ``<feature>_mean``, ``_median`` and ``_std``."""
    labelled = panel.where(F.col(label).isNotNull())
    moments = labelled.groupBy(label).agg(
        *[F.avg(f).alias(f"{f}_mean") for f in features],
        *[F.stddev_samp(f).alias(f"{f}_std") for f in features],
    )
    medians = (
        ordering.quantiles(labelled, features, [0.5], [label])
        .groupBy(label)
        .pivot("feature", list(features))
        .agg(F.first("quantile"))
    )
    medians = medians.select(label, *[F.col(f).alias(f"{f}_median") for f in features])
    return moments.join(medians, label, "left")


def target_by_label(panel: DataFrame, target: str, label: str) -> DataFrame:
    """Count, minimum, maximum, mean, median and deviation of the target per label."""
    labelled = panel.where(F.col(label).isNotNull())
    moments = labelled.groupBy(label).agg(
        F.count(target).alias("n"),
        F.min(target).alias("min"),
        F.max(target).alias("max"),
        F.avg(target).alias("mean"),
        F.stddev_samp(target).alias("std"),
    )
    medians = ordering.quantiles(labelled, [target], [0.5], [label]).select(label, F.col("quantile").alias("median"))
    return moments.join(medians, label, "left")


def iqr_outliers(panel: DataFrame, features: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Values strictly beyond the quartile fences, in count and percent.

    The fences come back as one row, so counting is a plain scan.
    """
    names = {0.25: "q1", 0.75: "q3"}
    fences = ordering.quantile_columns(ordering.quantiles(panel, features, list(names)), names)
    spread = F.col("q3") - F.col("q1")
    fences = fences.select(
        "feature",
        "q1",
        "q3",
        spread.alias("iqr"),
        (F.col("q1") - reach * spread).alias("lower_fence"),
        (F.col("q3") + reach * spread).alias("upper_fence"),
    )
    limits = fences.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("lower_fence", "upper_fence"))))
    ).scalar()
    counts = (
        ordering.melt(panel, features)
        .withColumn("limit", limits[F.col("feature")])
        .groupBy("feature")
        .agg(
            F.count_if(
                (F.col("value") < F.col("limit.lower_fence")) | (F.col("value") > F.col("limit.upper_fence"))
            ).alias("outliers"),
            F.count("*").alias("n"),
        )
    )
    return fences.join(counts, "feature").withColumn("outlier_percent", percent(F.col("outliers"), F.col("n")))


def spearman(
    panel: DataFrame, target: str, features: Sequence[str], min_pairs: int = 1, digits: int | None = 9
) -> DataFrame:
    """Rank correlation of each feature with the target over complete pairs.

    Values are rounded to ``digits`` first: means and deviations that tie on
    paper differ in their last bits by the order of addition.

    Equal rows are counted first. Ranks of the target are worked out for all features at once, over the rows
    that have the feature, and looked up per distinct value: an outsized value
    only widens one side of a join whose other side has one row per value, a
    shape the skew join can split. A feature then needs, per distinct value, its
    rows and the sum of their target ranks, which combine map-side. The rows are
    kept once, since means added up again may differ in their last bits.
    """
    def even(name: str) -> Column:
        value = F.col(name).cast("double")
        return value if digits is None else F.round(value, digits)

    numbers = {f: f"n{i}" for i, f in enumerate(features)}
    wide = panel.select(even(target).alias("y"), *[even(f).alias(f"x{i}") for i, f in enumerate(features)])
    wide = cut_lineage(wide.where(F.col("y").isNotNull()).groupBy(*wide.columns).agg(F.count("*").alias("m")))
    having = [F.when(F.col(f"x{i}").isNotNull(), F.col("m")).otherwise(0) for i in range(len(features))]
    values = wide.groupBy("y").agg(*[F.sum(h).alias(n) for h, n in zip(having, numbers.values())])
    targets = ordering.ranked(values, [], "y", list(numbers.values()))
    targets = targets.select(
        "y",
        *numbers.values(),
        *[(F.col(f"rank_{n}") - (F.col(f"total_{n}") + 1) / 2).alias(f"r{i}") for i, n in enumerate(numbers.values())],
    )
    sides = [F.struct(F.lit(f).alias("feature"), F.col(f"x{i}").alias("x"), F.col("m"), (F.col("m") * F.col(f"r{i}")).alias("ry")) for i, f in enumerate(features)]
    sums = (
        wide.join(targets.drop(*numbers.values()), "y")
        .select(F.explode(F.array(*sides)).alias("_s"))
        .select("_s.*")
        .where(F.col("x").isNotNull())
        .groupBy("feature", "x")
        .agg(F.sum("m").alias("n"), F.sum("ry").alias("ry"))
    )
    n, rx = F.col("n"), F.col("rank_n") - (F.col("total_n") + 1) / 2
    found = (
        ordering.ranked(sums, ["feature"], "x")
        .groupBy("feature")
        .agg(F.sum("n").alias("pairs"), F.sum(F.col("ry") * rx).alias("_xy"), F.sum(n * rx * rx).alias("_xx"))
    )
    squares = targets.agg(*[F.sum(F.col(m) * F.col(f"r{i}") * F.col(f"r{i}")).alias(f) for i, (f, m) in enumerate(numbers.items())])
    squares = squares.unpivot([], list(features), "feature", "_yy")
    rho = F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy")))
    return found.join(squares, "feature").select("feature", "pairs", F.when(F.col("pairs") >= min_pairs, rho).alias("rho"))


def top_by_magnitude(correlations: DataFrame, k: int, largest: bool = True) -> DataFrame:
    """The k features with the largest (or smallest) absolute correlation."""
    size = F.abs("rho")
    order = size.desc_nulls_last() if largest else size.asc_nulls_last()
    return correlations.orderBy(order, "feature").limit(k)


def lowest_coverage(coverage: DataFrame, subject: str, k: int) -> DataFrame:
    return coverage.orderBy("target_coverage_percent", subject, "modality").limit(k)


def weekly_trend(panel: DataFrame, spec: PanelSpec, by: Sequence[str] = ("semester_week",)) -> DataFrame:
    """Rows, mean, sample deviation, first and last day per calendar week."""
    return panel.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(spec.target).alias("mean_score"),
        F.stddev_samp(spec.target).alias("sd_score"),
        F.min(spec.day).alias("week_start"),
        F.max(spec.day).alias("week_end"),
    )


def weekly_band(weekly: DataFrame, top: float = 100.0) -> DataFrame:
    """Mean +- one deviation, kept inside [0, max(top, largest upper edge)]."""
    upper = F.col("mean_score") + F.coalesce("sd_score", F.lit(0.0))
    lower = F.col("mean_score") - F.coalesce("sd_score", F.lit(0.0))
    limit = weekly.agg(F.greatest(F.lit(top), F.max(upper))).scalar()
    return weekly.select(
        "semester_week",
        "mean_score",
        F.greatest(F.lit(0.0), lower).alias("band_low"),
        F.least(limit, upper).alias("band_high"),
    )


def extreme_weeks(weekly: DataFrame) -> DataFrame:
    """Weeks with the highest and the lowest mean; the earlier week wins a tie."""
    high = F.struct(F.col("mean_score"), -F.col("semester_week"))
    low = F.struct(F.col("mean_score"), F.col("semester_week"))
    return weekly.where(F.col("mean_score").isNotNull()).agg(
        F.max_by("semester_week", high).alias("peak_week"),
        F.max("mean_score").alias("peak_mean"),
        F.min_by("semester_week", low).alias("low_week"),
        F.min("mean_score").alias("low_mean"),
    )


def weekday_weekend(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows, mean, deviation and median of the target by day type."""
    typed = panel.withColumn("day_type", scalars.day_type(F.col("day_of_week")))
    moments = typed.groupBy("day_type").agg(
        F.count("*").alias("n"),
        F.avg(spec.target).alias("mean_score"),
        F.stddev_samp(spec.target).alias("sd_score"),
    )
    medians = ordering.quantiles(typed, [spec.target], [0.5], ["day_type"]).select(
        "day_type", F.col("quantile").alias("median_score")
    )
    return moments.join(medians, "day_type", "left")


def histogram_fixed(panel: DataFrame, column: str, width: int = 5, stop: int = 100) -> DataFrame:
    """Left-closed bins of equal width below ``stop``; empty bins are kept.

    A value equal to ``stop`` lies outside.
    """
    bins = panel.sparkSession.range(0, stop // width).select(F.col("id").cast("int").alias("bin"))
    inside = (F.col(column) >= 0) & (F.col(column) < stop)
    counts = (
        panel.where(inside)
        .groupBy(F.floor(F.col(column) / width).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    return bins.join(counts, "bin", "left").select(
        (F.col("bin") * width).cast("int").alias("bin_start"),
        ((F.col("bin") + 1) * width).cast("int").alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def histogram_equal_width(panel: DataFrame, features: Sequence[str], bins: int = 12) -> DataFrame:
    """Right-closed bins over each feature's range, the minimum in the first.

    A constant feature gets a range of 0.1 % of its value on both sides, or of
    0.001 at zero.
    """

    def widened(f: str) -> Column:
        low, high = F.min(f).cast("double"), F.max(f).cast("double")
        pad = F.when(low == high, F.when(low == 0, 0.001).otherwise(F.abs(low) * 0.001)).otherwise(0.0)
        return F.struct((low - pad).alias("lo"), (high + pad).alias("hi")).alias(f)

    edges = panel.agg(*[widened(f) for f in features])
    edge = edges.select(F.create_map(*[x for f in features for x in (F.lit(f), F.col(f))])).scalar()
    # Rounded, so that a value on an edge stays on its left side.
    share = F.try_divide((F.col("value") - F.col("e.lo")) * bins, F.col("e.hi") - F.col("e.lo"))
    place = F.ceil(F.round(share, 9)).cast("int")
    counts = (
        ordering.melt(panel, features)
        .withColumn("e", edge[F.col("feature")])
        .groupBy("feature", F.least(F.lit(bins), F.greatest(F.lit(1), place)).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    grid = panel.sparkSession.range(1, bins + 1).select(
        F.col("id").cast("int").alias("bin"), F.explode(F.array(*[F.lit(f) for f in features])).alias("feature")
    )
    return grid.join(counts, ["feature", "bin"], "left").select(
        "feature", "bin", F.coalesce("n", F.lit(0)).alias("n")
    )


def standardised_means(panel: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Label means as distance from the overall mean in population deviations."""
    overall = scalars.single(
        panel.agg(
            *[F.struct(F.avg(f).alias("mean"), F.stddev_pop(f).alias("std")).alias(f) for f in features]
        )
    )
    means = panel.where(F.col(label).isNotNull()).groupBy(label).agg(*[F.avg(f).alias(f) for f in features])
    return means.withColumn("_all", overall).select(
        label,
        *[
            F.try_divide(F.col(f) - F.col(f"_all.{f}.mean"), F.col(f"_all.{f}.std")).alias(f)
            for f in features
        ],
    )


def dataset_summary(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Thirteen headline numbers as (metric, value) text rows."""
    per_subject = panel.groupBy(spec.subject).agg(
        F.count("*").alias("n_days"),
        F.min(spec.day).alias("first"),
        F.max(spec.day).alias("last"),
        *label_counts(spec.label),
    )
    # The number of days per subject takes few distinct values.
    median = scalars.single(
        ordering.quantiles(per_subject, ["n_days"], [0.5]), F.col("quantile").alias("v")
    )
    totals = per_subject.agg(
        F.count("*").alias("subjects"),
        F.sum("n_days").alias("rows"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.avg("n_days").alias("mean_days"),
        F.min("n_days").alias("min_days"),
        F.max("n_days").alias("max_days"),
        *[F.sum(x.lower()).alias(x.lower()) for x in LABELS],
    ).withColumn("median_days", median["v"])
    share = {x.lower(): F.round(percent(F.col(x.lower()), F.col("rows")), 2) for x in LABELS}
    metrics = {
        "subjects": F.col("subjects"),
        "rows": F.col("rows"),
        "day_range": F.concat_ws(" to ", F.col("first").cast("string"), F.col("last").cast("string")),
        "mean_days_per_subject": F.round("mean_days", 2),
        "median_days_per_subject": F.round("median_days", 2),
        "min_days_per_subject": F.col("min_days"),
        "max_days_per_subject": F.col("max_days"),
        **{f"{x.lower()}_count": F.col(x.lower()) for x in LABELS},
        **{f"{x.lower()}_percent": share[x.lower()] for x in LABELS},
    }
    return long_metrics(totals.select(*[v.cast("string").alias(k) for k, v in metrics.items()]))


def long_metrics(one_row: DataFrame) -> DataFrame:
    """Columns of a one-row table as (metric, value) rows of text."""
    names = one_row.columns
    texts = one_row.select(*[F.col(c).cast("string").alias(c) for c in names])
    return texts.unpivot([], names, "metric", "value")


def target_audit(answers: DataFrame, spec: PanelSpec, given_label: str | None = None) -> DataFrame:
    """Questionnaire totals: rows, keys, repeated keys, range, missing, labels."""
    rebuilt = scalars.band(F.col(spec.target), spec.thresholds)
    stored = F.col(given_label or spec.label)
    differs = ~F.coalesce(rebuilt, F.lit("")).eqNullSafe(F.coalesce(stored, F.lit("")))
    per_key = answers.groupBy(*spec.key).agg(
        F.count("*").alias("n"),
        F.min(spec.target).alias("lo"),
        F.max(spec.target).alias("hi"),
        F.count_if(F.col(spec.target).isNull()).alias("no_target"),
        F.count_if(F.col(spec.secondary).isNull()).alias("no_secondary"),
        F.count_if(differs).alias("mismatch"),
    )
    return per_key.agg(
        F.sum("n").alias("rows"),
        F.count_distinct(spec.subject).alias("subjects"),
        F.count("*").alias("subject_days"),
        F.count_if(F.col("n") > 1).alias("repeated_subject_days"),
        F.sum("mismatch").alias("label_mismatches"),
        F.min("lo").alias("target_min"),
        F.max("hi").alias("target_max"),
        F.sum("no_target").alias("target_missing_rows"),
        F.sum("no_secondary").alias("secondary_missing_rows"),
    )


def panel_audit(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row: size, repeated keys, missing cells, complete rows, labels.

    Two groupings, the first by key, so a panel is read once.
    """
    features = spec.features
    missing = [*features, spec.target, spec.secondary, spec.device_score, spec.device_flag]
    per_key = panel.groupBy(*spec.key).agg(
        F.count("*").alias("n"),
        F.count_if(_all_present(features)).alias("complete"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in missing],
        *label_counts(spec.label),
    )
    row = per_key.agg(
        F.sum("n").alias("rows"),
        F.count_distinct(spec.subject).alias("subjects"),
        F.count("*").alias("subject_days"),
        F.min(spec.day).alias("day_min"),
        F.max(spec.day).alias("day_max"),
        F.sum(F.col("n") - 1).alias("surplus_rows"),
        F.count_if(F.col("n") > 1).alias("repeated_keys"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("rows_of_repeated_keys"),
        F.sum("complete").alias("complete_rows"),
        *[F.sum(x.lower()).alias(f"label_{x.lower()}") for x in LABELS],
        *[F.sum(f"missing_{c}").alias(f"missing_{c}") for c in missing],
    )
    cells = reduce(lambda a, b: a + b, [F.col(f"missing_{f}") for f in features])
    return (
        row.withColumn("missing_cells", cells)
        .withColumn("total_cells", F.col("rows") * len(features))
        .withColumn("missing_percent", F.round(percent(F.col("missing_cells"), F.col("total_cells")), 2))
        .withColumn("complete_percent", F.round(percent(F.col("complete_rows"), F.col("rows")), 2))
    )


def stage_audit(rows: DataFrame, clean: DataFrame, model: DataFrame, spec: PanelSpec) -> DataFrame:
    """Audits of the build, the cleaning and the model table as (stage, metric, value)."""
    from panelloom.operators.clean import duplicate_summary

    parts = [
        long_metrics(panel_audit(rows, spec)).withColumn("stage", F.lit("build")),
        long_metrics(duplicate_summary(rows, spec)).withColumn("stage", F.lit("duplicates")),
        long_metrics(panel_audit(clean, spec)).withColumn("stage", F.lit("clean")),
    ]
    splits = split_summary(model, spec)
    names = [c for c in splits.columns if c != "split"]
    parts.append(
        splits.unpivot(["split"], names, "name", "value").select(
            F.concat_ws("_", "split", "name").alias("metric"),
            F.col("value").cast("string").alias("value"),
            F.lit("model").alias("stage"),
        )
    )
    return reduce(lambda a, b: a.unionByName(b), parts).select("stage", "metric", "value")
