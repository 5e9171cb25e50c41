"""Checks that stop a run before wrong results are produced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions import scalars
from panelloom.operators.prep import null_guard
from panelloom.operators.temporal import LAG1, ROLL3, ROLL7
from panelloom.spec import PanelSpec


def require_columns(frame: DataFrame, columns: Sequence[str], context: str = "table") -> None:
    missing = sorted(set(columns) - set(frame.columns))
    if missing:
        raise ValueError(f"{context} lacks columns: {missing}")


def require_no_nulls(frame: DataFrame, features: Sequence[str], context: str = "table") -> None:
    """Raise with the offending features; at most one row per feature is fetched."""
    require_columns(frame, features, context)
    found = {r.feature: r.null_rows for r in null_guard(frame, features).collect()}
    if found:
        raise ValueError(f"{context} has nulls in: {found}")


def require_leak_free(columns: Sequence[str], spec: PanelSpec) -> None:
    """No identity, target or target history among model inputs."""
    banned = sorted(set(columns) & set(spec.forbidden_inputs))
    if banned:
        raise ValueError(f"not allowed as model inputs: {banned}")
    history = sorted(c for c in columns if c.startswith((f"{spec.target}_", f"{spec.secondary}_")))
    if history:
        raise ValueError(f"target history is not allowed as model input: {history}")


def require_temporal_design(frame: DataFrame, conditions: dict[str, Sequence[str]], spec: PanelSpec) -> None:
    """Conditions are leak-free, present in the table and complete."""
    used = {c for columns in conditions.values() for c in columns}
    require_leak_free(sorted(used), spec)
    require_columns(frame, sorted(used), "temporal table")
    for suffix in (LAG1, ROLL3, ROLL7):
        absent = sorted(f"{f}{suffix}" for f in spec.features if f"{f}{suffix}" not in used)
        if absent:
            raise ValueError(f"temporal conditions are incomplete: {absent}")


def require_unique_key(frame: DataFrame, spec: PanelSpec) -> None:
    repeated = frame.groupBy(*spec.key).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    if not repeated.isEmpty():
        raise ValueError(f"{spec.key} is not a unique key")


def label_mismatch(frame: DataFrame, spec: PanelSpec, stored: str) -> DataFrame:
    """Rows whose stored label is not the one the target implies."""
    rebuilt = F.coalesce(scalars.band(F.col(spec.target), spec.thresholds), F.lit(""))
    return frame.agg(
        F.count("*").alias("rows"),
        F.count_if(rebuilt != F.coalesce(F.col(stored), F.lit(""))).alias("mismatches"),
    )
