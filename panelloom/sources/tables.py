"""Tables, column lists and audits on disk."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from panelloom.spec import PanelSpec


def panel_schema(spec: PanelSpec, extra: tuple[T.StructField, ...] = ()) -> T.StructType:
    kinds = {
        spec.subject: T.StringType(),
        spec.day: T.DateType(),
        spec.label: T.StringType(),
        spec.device_flag: T.BooleanType(),
    }
    fields = [T.StructField(c, kinds.get(c, T.DoubleType())) for c in spec.columns]
    return T.StructType([*fields, *extra])


def read_panel_csv(spark: SparkSession, path: str, spec: PanelSpec, extra: tuple[T.StructField, ...] = ()) -> DataFrame:
    """A panel kept as CSV with header; empty cells are null."""
    return (
        spark.read.schema(panel_schema(spec, extra))
        .option("header", True)
        .option("enforceSchema", False)
        .csv(path)
    )


def with_panel_types(frame: DataFrame, spec: PanelSpec) -> DataFrame:
    """Cast the role columns of any loaded table to the panel types."""
    wanted = {f.name: f.dataType for f in panel_schema(spec).fields}
    return frame.select(*[frame[c].cast(wanted[c]).alias(c) if c in wanted else frame[c] for c in frame.columns])


def write_table(
    frame: DataFrame,
    path: str,
    partition_by: tuple[str, ...] = (),
    fmt: str = "parquet",
    order: Sequence[str] = (),
) -> None:
    """Write a table; with ``order`` sorted over all its files, each of which then holds one range."""
    if order:
        frame = frame.orderBy(*order)
    writer = frame.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_audit(metrics: DataFrame, path: str) -> None:
    """Long (metric, value) table as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def parse_column_sets(text: str) -> dict:
    return json.loads(text)


def read_column_sets(spark: SparkSession, path: str) -> dict:
    """Named column lists from one JSON document, nested one level or not."""
    row = spark.read.text(path, wholetext=True).first()
    return parse_column_sets(row[0])


def write_column_sets(spark: SparkSession, sets: dict, path: str) -> None:
    frame = spark.createDataFrame([(json.dumps(sets, sort_keys=True),)], "value string")
    frame.write.mode("overwrite").text(path)


def column_set(sets: dict, *names: str) -> list[str]:
    """Look a list up by its path; an unknown name raises KeyError."""
    found = sets
    for name in names:
        found = found[name]
    return list(found)
