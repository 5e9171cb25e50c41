"""Readings to subject-days.

``daily_table`` computes every daily column of every kind of reading in one
grouping, so a panel costs one shuffle of partial aggregates.  The single-kind
operators are the same grouping restricted to one kind.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions import scalars
from panelloom.sources.readings import Measure
from panelloom.spec import PanelSpec


def _usable(measure: Measure) -> Column:
    """Rows that put a day on record for this measure."""
    own = F.col("modality") == measure.modality
    return own & F.col(measure.source).isNotNull() if measure.how == "level" else own


def measure_column(measure: Measure) -> Column:
    """Daily aggregate of one measure over a group that mixes all kinds."""
    own = F.col("modality") == measure.modality
    value = F.when(own, F.col(measure.source))
    present = F.count_if(_usable(measure)) > 0
    if measure.how == "mean":
        return F.avg(value)
    if measure.how == "std":
        return F.stddev_samp(value)
    if measure.how == "any":
        return F.bool_or(value)
    if measure.how == "sum":
        # All readings null: the day is on record with a sum of zero.
        return F.when(present, F.coalesce(F.sum(value), F.lit(0.0)))
    if measure.how == "level":
        hits = F.count_if(own & (F.col(measure.source) == measure.level))
        return F.when(present, hits.cast("double"))
    raise ValueError(f"unknown aggregate {measure.how!r}")


def daily_table(readings: DataFrame, key: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """One row per (subject, day) with any usable reading of the given kinds."""
    kinds = reduce(lambda a, b: a | b, [_usable(m) for m in measures])
    dated = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    return (
        readings.where(kinds & dated)
        .groupBy(*key)
        .agg(*[measure_column(m).alias(m.out) for m in measures])
    )


def daily_modality(readings: DataFrame, key: Sequence[str], measures: Sequence[Measure], modality: str) -> DataFrame:
    """The daily table of one kind of reading."""
    return daily_table(readings, key, [m for m in measures if m.modality == modality])


def target_rows(
    readings: DataFrame, spec: PanelSpec, modality: str, score: str, secondary: str, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per answered questionnaire; a subject may answer twice a day."""
    return (
        readings.where((F.col("modality") == modality) & F.col(spec.day).isNotNull())
        .select(*spec.key, F.col(score).alias(spec.target), F.col(secondary).alias(spec.secondary), *keep)
        .withColumn(spec.label, scalars.band(F.col(spec.target), spec.thresholds))
    )


def enrich(targets: DataFrame, daily: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Left-join daily tables to target rows; repeated target keys stay repeated.

    Each daily table is already partitioned by the key after its grouping, so
    the chain moves only the target rows.
    """
    return reduce(lambda left, right: left.join(right, list(key), "left"), daily, targets)


def subject_day_rows(
    readings: DataFrame, spec: PanelSpec, measures: Sequence[Measure], modality: str, score: str, secondary: str
) -> DataFrame:
    """Target rows with all daily columns, repeated keys kept."""
    targets = target_rows(readings, spec, modality, score, secondary)
    return enrich(targets, [daily_table(readings, spec.key, measures)], spec.key).select(*spec.columns)


def clean_panel(
    readings: DataFrame, spec: PanelSpec, measures: Sequence[Measure], modality: str, score: str, secondary: str
) -> DataFrame:
    """Subject-days with repeated answers averaged: one grouping, no join.

    Daily columns are constant within a key, so averaging the enriched rows is
    the same as averaging the answers alone.
    """
    target = [Measure(spec.target, modality, score, "mean"), Measure(spec.secondary, modality, secondary, "mean")]
    columns = [*target, *measures]
    answered = F.count_if(F.col("modality") == modality)
    dated = F.col(spec.subject).isNotNull() & F.col(spec.day).isNotNull()
    return (
        readings.where(dated)
        .groupBy(*spec.key)
        .agg(answered.alias("_answers"), *[measure_column(m).alias(m.out) for m in columns])
        .where(F.col("_answers") > 0)
        .withColumn(spec.label, scalars.band(F.col(spec.target), spec.thresholds))
        .select(*spec.columns)
    )
