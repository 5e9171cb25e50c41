"""Preprocessing learnt from training rows only.

Each step exists twice over the same computation: as a table function whose
statistics enter the plan as a one-row subquery, and as a Spark ML estimator
for use in a ``Pipeline``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions import ordering, scalars

def median_row(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row with the exact median of every feature."""
    long = ordering.quantiles(train, features, [0.5])
    return long.agg(*[F.max(F.when(F.col("feature") == f, F.col("quantile"))).alias(f) for f in features])


def median_impute(frame: DataFrame, train: DataFrame, features: Sequence[str]) -> DataFrame:
    medians = scalars.single(median_row(train, features))
    filled = {f: F.coalesce(F.col(f), F.col(f"_medians.{f}")) for f in features}
    return frame.withColumn("_medians", medians).withColumns(filled).drop("_medians")


def mode_value(train: DataFrame, column: str) -> Column:
    """Most frequent value, the smallest one on a tie, as a scalar subquery."""
    counts = train.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.agg(F.min_by(column, F.struct(-F.col("n"), F.col(column)))).scalar()


def mode_impute(frame: DataFrame, train: DataFrame, column: str) -> DataFrame:
    return frame.withColumn("_mode", mode_value(train, column)).withColumn(
        column, F.coalesce(F.col(column), F.col("_mode"))
    ).drop("_mode")


def _moments(features: Sequence[str]) -> list[Column]:
    return [F.struct(F.avg(f).alias("mean"), F.stddev_pop(f).alias("std")).alias(f) for f in features]


def _scaled(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / F.when(std == 0, 1.0).otherwise(std)


def standard_scale(frame: DataFrame, train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Centre and divide by the population deviation; constants are only centred."""
    moments = scalars.single(train.agg(*_moments(features)))
    scaled = {f: _scaled(F.col(f), F.col(f"_m.{f}.mean"), F.col(f"_m.{f}.std")) for f in features}
    return frame.withColumn("_m", moments).withColumns(scaled).drop("_m")


def vocabulary(train: DataFrame, column: str) -> DataFrame:
    """(value, code) of the training categories in sorted order, codes from 0."""
    values = train.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return ordering.with_sorted_ordinal(values, ["value"], "code")


def ordinal_encode(frame: DataFrame, train: DataFrame, column: str, out: str) -> DataFrame:
    """Code plus one; 0 stands for a category unknown to training or missing."""
    codes = vocabulary(train, column).withColumnRenamed("value", column)
    return (
        frame.join(codes, column, "left")
        .withColumn(out, (F.coalesce("code", F.lit(-1)) + 1).cast("bigint"))
        .drop("code")
    )


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c) and weights scaled to a mean of one.

    The grouping leaves one row per class, which the two totals then read.
    """
    counts = train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    inverse = F.try_divide(F.lit(1.0), F.col("n"))
    totals = scalars.single(
        counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"), F.avg(inverse).alias("mean_inverse"))
    )
    return counts.withColumn("_t", totals).select(
        label,
        "n",
        (F.col("_t.rows") / (F.col("_t.classes") * F.col("n"))).alias("balanced_weight"),
        (inverse / F.col("_t.mean_inverse")).alias("normalised_weight"),
    )


def null_guard(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features that still have nulls, with their counts."""
    counts = frame.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features])
    return counts.unpivot([], list(features), "feature", "null_rows").where(F.col("null_rows") > 0)


class _Columns(HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None) -> None:
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=list(inputCols))


class MedianImputer(_Columns, Estimator):
    """Exact medians; a column without any value is filled with zero."""

    def _fit(self, dataset: DataFrame) -> "ColumnFill":
        features = self.getInputCols()
        row = median_row(dataset, features).first()
        return ColumnFill({f: row[f] if row[f] is not None else 0.0 for f in features})


class ColumnFill(Model):
    def __init__(self, values: dict[str, float]) -> None:
        super().__init__()
        self.values = values

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns(
            {c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in self.values.items()}
        )


class PopulationScaler(_Columns, Estimator):
    """Standardisation by the population deviation."""

    def _fit(self, dataset: DataFrame) -> "ColumnScale":
        row = dataset.agg(*_moments(self.getInputCols())).first()
        return ColumnScale({f: (row[f]["mean"], row[f]["std"] or 1.0) for f in self.getInputCols()})


class ColumnScale(Model):
    def __init__(self, moments: dict[str, tuple[float, float]]) -> None:
        super().__init__()
        self.moments = moments

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.moments.items()})
