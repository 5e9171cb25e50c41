"""Which target days are covered by which kind of reading.

All measures here come from one table of distinct (subject, day, modality)
combined into a row per (subject, day): no set is ever built per subject.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.scalars import percent


def day_flags(
    readings: DataFrame, key: Sequence[str], modalities: Sequence[str], target: str, target_value: str
) -> DataFrame:
    """(subject, day, has_<modality>...) over all days with a reading.

    A target day needs a non-null target value; any reading covers its day.
    """

    def seen(modality: str) -> Column:
        own = F.col("modality") == modality
        if modality == target:
            own = own & F.col(target_value).isNotNull()
        return F.coalesce(F.bool_or(own), F.lit(False)).alias(f"has_{modality}")

    dated = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    return readings.where(dated).groupBy(*key).agg(*[seen(m) for m in modalities])


def target_coverage(flags: DataFrame, subject: str, modalities: Sequence[str], target: str) -> DataFrame:
    """Per subject and kind: target days, covered target days, percent."""
    on_target = flags.groupBy(subject).agg(
        F.count_if(f"has_{target}").alias("target_days"),
        *[F.count_if(F.col(f"has_{target}") & F.col(f"has_{m}")).alias(m) for m in modalities],
    )
    return on_target.unpivot(
        [subject, "target_days"], list(modalities), "modality", "covered_target_days"
    ).withColumn("target_coverage_percent", percent(F.col("covered_target_days"), F.col("target_days")))


def complete_days(flags: DataFrame, wearables: Sequence[str], target: str) -> DataFrame:
    """Target days on which every kind of wearable reading exists."""
    everything = reduce(lambda a, b: a & b, [F.col(f"has_{m}") for m in [target, *wearables]])
    return flags.where(everything).drop(*[c for c in flags.columns if c.startswith("has_")])


def subject_availability(
    flags: DataFrame, subject: str, modalities: Sequence[str], wearables: Sequence[str], target: str, files: DataFrame
) -> DataFrame:
    """Per subject: target days, complete days, percent, whether all kinds exist.

    ``files`` lists the (subject, modality) pairs that exist at all.
    """
    full = reduce(lambda a, b: a & b, [F.col(f"has_{m}") for m in [target, *wearables]])
    days = flags.groupBy(subject).agg(
        F.count_if(f"has_{target}").alias("target_days"), F.count_if(full).alias("complete_target_days")
    )
    kinds = (
        files.where(F.col("modality").isin(list(modalities)))
        .groupBy(subject)
        .agg((F.count_distinct("modality") == len(modalities)).cast("int").alias("has_all_modalities"))
    )
    return (
        kinds.join(days, subject, "left")
        .na.fill(0, ["target_days", "complete_target_days"])
        .withColumn("complete_target_percent", percent(F.col("complete_target_days"), F.col("target_days")))
    )


def audit_summary(availability: DataFrame) -> DataFrame:
    """One row over all subjects: sizes, complete days, complete folders."""
    totals = availability.agg(
        F.count("*").alias("subjects"),
        F.sum(F.col("has_all_modalities").cast("bigint")).alias("subjects_with_all_modalities"),
        F.sum("target_days").alias("target_days"),
        F.sum("complete_target_days").alias("complete_target_days"),
    )
    share = percent(F.col("complete_target_days"), F.col("target_days"))
    return totals.withColumn("complete_target_percent", share)


def coverage_summary(coverage: DataFrame, subject: str) -> DataFrame:
    """Per kind: totals, mean of the subjects' percents, overall percent."""
    return (
        coverage.groupBy("modality")
        .agg(
            F.count(subject).alias("subjects"),
            F.sum("target_days").alias("total_target_days"),
            F.sum("covered_target_days").alias("covered_target_days"),
            F.avg("target_coverage_percent").alias("mean_subject_coverage_percent"),
        )
        .withColumn("overall_coverage_percent", percent(F.col("covered_target_days"), F.col("total_target_days")))
    )


def modality_audit(
    readings: DataFrame, subject: str, day: str, values: dict[str, Sequence[str]], files: DataFrame | None = None
) -> DataFrame:
    """One row per subject and expected kind, also where the kind is absent.

    ``values`` names the value columns of each kind, whose empty cells count.
    """
    cells = F.lit(0)
    width = F.lit(0)
    for modality, columns in values.items():
        own = F.col("modality") == modality
        empty = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])
        cells = F.when(own, empty).otherwise(cells)
        width = F.when(own, len(columns)).otherwise(width)
    observed = (
        readings.withColumns({"_empty": cells, "_width": width})
        .groupBy(subject, "modality")
        .agg(
            F.count("*").alias("rows"),
            F.count_distinct(day).alias("unique_days"),
            F.sum("_empty").alias("missing_cells"),
            F.sum("_width").alias("total_cells"),
            F.min(day).alias("min_day"),
            F.max(day).alias("max_day"),
        )
    )
    present = observed.select(subject, "modality") if files is None else files
    grid = present.groupBy(subject).agg(F.collect_set("modality").alias("_have"))
    grid = grid.select(
        subject, "_have", F.explode(F.array(*[F.lit(m) for m in values])).alias("modality")
    ).select(subject, "modality", F.array_contains("_have", F.col("modality")).cast("int").alias("exists"))
    counts = ["rows", "unique_days", "missing_cells", "total_cells"]
    return (
        grid.join(observed, [subject, "modality"], "left")
        .na.fill(0, counts)
        .withColumn("missing_percent", percent(F.col("missing_cells"), F.col("total_cells")))
    )


def missing_files(audit: DataFrame) -> DataFrame:
    """Kind of reading -> number of subjects without it."""
    return audit.groupBy("modality").agg(F.count_if(F.col("exists") == 0).alias("subjects_without"))


def key_flags(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys of both tables with the side or sides they occur on."""
    sides = left.select(*key, F.lit("l").alias("_side")).unionByName(right.select(*key, F.lit("r").alias("_side")))
    return sides.groupBy(*key).agg(
        F.bool_or(F.col("_side") == "l").alias("in_left"), F.bool_or(F.col("_side") == "r").alias("in_right")
    )


def key_diff(left: DataFrame, right: DataFrame, key: Sequence[str], subject: str) -> DataFrame:
    """Per subject: keys kept, dropped and added going from left to right."""
    return key_flags(left, right, key).groupBy(subject).agg(
        F.count_if("in_left").alias("left_days"),
        F.count_if("in_right").alias("right_days"),
        F.count_if(F.col("in_left") & F.col("in_right")).alias("kept"),
        F.count_if(F.col("in_left") & ~F.col("in_right")).alias("dropped"),
        F.count_if(~F.col("in_left") & F.col("in_right")).alias("extra"),
    )


def key_set_operations(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Sizes of intersection and both differences."""
    return key_flags(left, right, key).agg(
        F.count_if(F.col("in_left") & F.col("in_right")).alias("in_both"),
        F.count_if(F.col("in_left") & ~F.col("in_right")).alias("left_only"),
        F.count_if(~F.col("in_left") & F.col("in_right")).alias("right_only"),
    )
