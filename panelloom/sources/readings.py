"""Readings in long form: one row per reading, tagged with its kind.

Every daily feature of every kind can then be computed by one grouping over
(subject, day), without joining the kinds to one another.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions import scalars
from panelloom.sources import files
from panelloom.spec import EVENTS, WEARABLE, PanelSpec


@dataclass(frozen=True)
class Measure:
    """One daily column: ``how`` is mean, std, sum, any or level."""

    out: str
    modality: str
    source: str
    how: str
    level: str | None = None


# Activity levels and their daily columns.
ACTIVITY_LEVELS = {
    "SEDENTARY": "sedentary_minutes",
    "LIGHTLY_ACTIVE": "lightly_active_minutes",
    "MODERATELY_ACTIVE": "moderately_active_minutes",
    "VERY_ACTIVE": "very_active_minutes",
}


def _levels(modality: str, source: str) -> list[Measure]:
    return [Measure(out, modality, source, "level", level) for level, out in ACTIVITY_LEVELS.items()]


WEARABLE_MEASURES = [
    Measure("sleep_score", "sleep", "overall_score", "mean"),
    Measure("deep_sleep_minutes", "sleep", "deep_sleep_in_minutes", "mean"),
    Measure("total_steps", "steps", "steps", "sum"),
    *_levels("activity_level", "level"),
    Measure("avg_rmssd", "hrv", "rmssd", "mean"),
    Measure("avg_low_frequency", "hrv", "low_frequency", "mean"),
    Measure("avg_high_frequency", "hrv", "high_frequency", "mean"),
    Measure("avg_oxygen", "oxygen", "value", "mean"),
    Measure("std_oxygen", "oxygen", "value", "std"),
    Measure("STRESS_SCORE", "stress", "STRESS_SCORE", "mean"),
    Measure("CALCULATION_FAILED", "stress", "CALCULATION_FAILED", "any"),
]
TARGET_MODALITY = "daily_questions"


def file_day(modality: str) -> Column:
    if modality == TARGET_MODALITY:
        return scalars.unix_day(F.col("timeStampStart"))
    return scalars.lenient_day(F.col("DATE" if modality == "stress" else "timestamp"))


def file_readings(spark: SparkSession, root: str, spec: PanelSpec = WEARABLE) -> DataFrame:
    """Union of the seven file scans; rows without a readable day stay, for audits."""
    return _long({m: files.scan_modality(spark, root, m, spec.subject) for m in files.MODALITIES}, spec)


def readings_of(spark: SparkSession, headers: dict[str, files.Headers], spec: PanelSpec = WEARABLE) -> DataFrame:
    """Readings of the files named by kind and header, with their path."""
    scans = {m: files.scan_files(spark, headers.get(m, {}), m, spec.subject) for m in files.MODALITIES}
    return _long(scans, spec, "path")


def _long(scans: dict[str, DataFrame], spec: PanelSpec, *keep: str) -> DataFrame:
    parts = []
    for modality, scan in scans.items():
        # The target and a device reading share names, so sources get a prefix.
        sources = [F.col(c).alias(f"{modality}__{c}") for c in files.value_columns(modality)]
        day = file_day(modality).alias(spec.day)
        parts.append(scan.select(*keep, spec.subject, day, F.lit(modality).alias("modality"), *sources))
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)


def _prefixed(measures: list[Measure]) -> list[Measure]:
    return [Measure(m.out, m.modality, f"{m.modality}__{m.source}", m.how, m.level) for m in measures]


FILE_MEASURES = _prefixed(WEARABLE_MEASURES)

# The events table carries five kinds of reading in one table.
EVENT_MODALITIES = {
    "purchase": "target",
    "view": "sleep",
    "click": "movement",
    "signup": "activity",
    "error": "oxygen",
}
EVENT_WEARABLES = ["sleep", "movement", "activity", "oxygen"]
EVENT_MEASURES = [
    Measure("sleep_score", "sleep", "value", "mean"),
    Measure("deep_sleep_minutes", "sleep", "k", "mean"),
    Measure("total_steps", "movement", "value", "sum"),
    *_levels("activity", "level"),
    Measure("avg_rmssd", "movement", "value", "mean"),
    Measure("avg_low_frequency", "movement", "k", "mean"),
    Measure("avg_high_frequency", "movement", "product", "mean"),
    Measure("avg_oxygen", "oxygen", "value", "mean"),
    Measure("std_oxygen", "oxygen", "value", "std"),
    Measure("device_score", "oxygen", "k", "mean"),
    Measure("device_flag", "oxygen", "flag", "any"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_readings(spark: SparkSession, folder: str, spec: PanelSpec = EVENTS) -> DataFrame:
    """The events table as readings, in one scan of four columns."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    tag = F.create_map(*[F.lit(x) for pair in EVENT_MODALITIES.items() for x in pair])
    level = F.element_at(F.array(*[F.lit(x) for x in ACTIVITY_LEVELS]), (F.floor(F.col("k") / 25) + 1).cast("int"))
    return (
        table(spark, folder, "events")
        .where(F.col("event_type").isin(list(EVENT_MODALITIES)))
        .select(
            F.col("user_id").cast("string").alias(spec.subject),
            F.to_date("ts").alias(spec.day),
            F.col("event_id"),
            tag[F.col("event_type")].alias("modality"),
            F.col("value"),
            k.alias("k"),
        )
        .withColumns(
            {
                "level": level,
                "product": F.col("value") * F.col("k") / 100,
                "flag": F.col("k") >= 90,
            }
        )
    )
