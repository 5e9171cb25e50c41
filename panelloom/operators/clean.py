"""Repeated keys: resolve, profile, mark. Null keys never form a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions import scalars
from panelloom.spec import PanelSpec


def numeric_columns(frame: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in set(without)
    ]


def with_key(frame: DataFrame, key: Sequence[str]) -> DataFrame:
    return frame.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]))


def resolve_duplicates(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row per key: numeric columns averaged, flag any-true, label rebuilt."""
    numeric = numeric_columns(rows, without=[*spec.key, spec.device_flag])
    flags = [F.bool_or(spec.device_flag).alias(spec.device_flag)] if spec.device_flag in rows.columns else []
    resolved = (
        with_key(rows, spec.key)
        .groupBy(*spec.key)
        .agg(*[F.avg(c).alias(c) for c in numeric], *flags)
        .withColumn(spec.label, scalars.band(F.col(spec.target), spec.thresholds))
    )
    return resolved.select(*[c for c in rows.columns if c in resolved.columns])


def repeated_values(rows: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """(key..., value, n) for every value of every key that occurs more than once.

    Equal values are counted before the shuffle, so a key with very many rows
    arrives as its distinct values only.
    """
    counted = with_key(rows, key).groupBy(*key, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    repeated = counted.groupBy(*key).agg(F.sum("n").alias("_rows")).where(F.col("_rows") > 1).drop("_rows")
    return counted.join(repeated, list(key), "left_semi")


def duplicate_conflicts(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    """Repeated keys with row count, value lists and whether values disagree.

    A list shows every value as often as it occurs. It is put together from the
    counted values, so a key's rows are combined before the shuffle and what
    meets in a task is its distinct values; the text itself, the answer, grows
    with the key's rows.
    """
    key = spec.key
    labels = [
        F.max(F.when(F.col(spec.label) == name, F.lit(name))) for name in sorted(("Low", "Medium", "High"))
    ]
    missing = F.when(F.count_if(F.col(spec.label).isNull()) > 0, F.lit(""))
    present = F.array_compact(F.array(missing, *labels))
    known = F.array_distinct(F.array(F.min(spec.target), F.max(spec.target)))
    conflict = (F.size(F.array_compact(known)) > 1) | (
        F.count(spec.target).between(1, F.count("*") - 1)
    )
    profile = (
        with_key(rows, key)
        .groupBy(*key)
        .agg(
            F.count("*").alias("n_rows"),
            F.concat_ws("; ", present).alias("label_values"),
            conflict.alias("value_conflict"),
            (F.size(present) > 1).alias("label_conflict"),
        )
        .where(F.col("n_rows") > 1)
    )
    listed = profile
    for column in (spec.target, spec.secondary):
        counted = repeated_values(rows, key, column).where(F.col("value").isNotNull())
        text = F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.struct("value", "n"))),
                lambda v: F.array_repeat(v["value"].cast("string"), v["n"].cast("int")),
            )
        )
        lists = counted.groupBy(*key).agg(F.array_join(text, "; ").alias(f"{column}_values"))
        listed = listed.join(lists, list(key), "left").withColumn(
            f"{column}_values", F.coalesce(f"{column}_values", F.lit(""))
        )
    return listed


def duplicate_summary(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    """Four counts, with both meanings of a duplicate row under their own names."""
    groups = (
        with_key(rows, spec.key)
        .groupBy(*spec.key)
        .agg(
            F.count("*").alias("n"),
            (F.min(spec.target) != F.max(spec.target)).alias("scores_differ"),
            (F.min(spec.label) != F.max(spec.label)).alias("labels_differ"),
        )
        .where(F.col("n") > 1)
    )
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_of_repeated_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"),
        F.count("*").alias("repeated_keys"),
        F.count_if("scores_differ").alias("keys_with_score_conflict"),
        F.count_if("labels_differ").alias("keys_with_label_conflict"),
    )


def mark_duplicates(rows: DataFrame, key: Sequence[str], tiebreak: str) -> DataFrame:
    """Flag rows of repeated keys, and all of them but the first by ``tiebreak``.

    Written as an aggregate joined back: the aggregate combines map-side and an
    outsized key can be split by the skew join, which a window cannot.
    """
    per_key = with_key(rows, key).groupBy(*key).agg(F.count("*").alias("_n"), F.min(tiebreak).alias("_first"))
    return (
        rows.join(per_key, list(key), "left")
        .withColumn("in_repeated_key", F.coalesce(F.col("_n") > 1, F.lit(False)))
        .withColumn("is_surplus", F.coalesce(F.col(tiebreak) != F.col("_first"), F.lit(False)))
        .drop("_n", "_first")
    )
