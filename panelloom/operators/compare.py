"""Compare tables, rank conditions, combine results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelloom.operators.clean import with_key


def table_compare(old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row of differences between two versions of a keyed table.

    Versions are compared as multisets: (key, column, value) is counted with
    plus one for the new and minus one for the old version, and whatever does
    not cancel is a difference.  No value list is ever built.
    """
    versions = old.select(*key, *columns, F.lit(-1).alias("_v")).unionByName(
        new.select(*key, *columns, F.lit(1).alias("_v"))
    )
    versions = with_key(versions, key)
    long = versions.select(
        *key,
        "_v",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
        ).alias("e"),
    )
    left_over = (
        long.groupBy(*key, "e.c", "e.v")
        .agg(F.sum("_v").alias("d"))
        .groupBy(*key)
        .agg(*[F.bool_or((F.col("c") == c) & (F.col("d") != 0)).alias(f"_{c}") for c in columns])
    )
    sizes = versions.groupBy(*key).agg(
        F.count_if(F.col("_v") < 0).alias("old_n"), F.count_if(F.col("_v") > 0).alias("new_n")
    )
    common = (F.col("old_n") > 0) & (F.col("new_n") > 0)
    return sizes.join(left_over, list(key)).agg(
        F.coalesce(F.sum("old_n"), F.lit(0)).alias("old_rows"),
        F.coalesce(F.sum("new_n"), F.lit(0)).alias("new_rows"),
        F.count_if(F.col("old_n") > 0).alias("old_keys"),
        F.count_if(F.col("new_n") > 0).alias("new_keys"),
        F.count_if(common).alias("common_keys"),
        F.count_if(F.col("new_n") == 0).alias("old_only_keys"),
        F.count_if(F.col("old_n") == 0).alias("new_only_keys"),
        F.count_if(common & (F.col("old_n") != F.col("new_n"))).alias("different_row_counts"),
        *[F.count_if(common & F.col(f"_{c}")).alias(f"different_{c}") for c in columns],
    )


def best_per_group(
    results: DataFrame, group: Sequence[str], metric: str, tiebreak: Sequence[str], keep: int = 1
) -> DataFrame:
    """Rows with the highest metric of each group.

    The filter on the row number lets Spark cut each group down before the
    shuffle, so a large group does not travel whole.
    """
    order = Window.partitionBy(*group).orderBy(F.col(metric).desc_nulls_last(), *tiebreak)
    return results.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= keep).drop("_place")


def delta_vs_baseline(results: DataFrame, metric: str, condition: str, baseline: str, out: str = "delta") -> DataFrame:
    """Difference to the best row of the baseline condition."""
    reference = results.where(F.col(condition) == baseline).agg(F.max(metric)).scalar()
    return results.withColumn(out, F.col(metric) - reference)


def delta_vs_constant(results: DataFrame, metric: str, constant: float, out: str) -> DataFrame:
    return results.withColumn(out, F.col(metric).try_cast("double") - F.lit(constant))


def union_conditions(frames: dict[str, DataFrame], name: str = "condition") -> DataFrame:
    """Stack result tables under the name of their condition."""
    stacked = None
    for condition, frame in frames.items():
        tagged = frame.select(F.lit(condition).alias(name), "*")
        stacked = tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
    return stacked


def with_tuning(results: DataFrame, tuning: DataFrame, on: Sequence[str]) -> DataFrame:
    """Attach tuning scores and chosen parameters to result rows."""
    return results.join(tuning, list(on), "left")
