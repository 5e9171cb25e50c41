"""Panels over the given tables, as every query of the catalog uses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions import scalars
from panelloom.operators import daily, split, temporal
from panelloom.sources import readings as src
from panelloom.sources.readings import Measure
from panelloom.spec import EVENTS, PanelSpec


def readings(spark: SparkSession, folder: str) -> DataFrame:
    return src.event_readings(spark, folder)


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Target rows, repeated keys kept."""
    return daily.target_rows(readings(spark, folder), EVENTS, "target", "value", "k", keep=["event_id"])


def rows(spark: SparkSession, folder: str) -> DataFrame:
    """Target rows with daily columns, repeated keys kept."""
    return daily.subject_day_rows(readings(spark, folder), EVENTS, src.EVENT_MEASURES, "target", "value", "k")


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Subject-days with unique key and calendar columns."""
    clean = daily.clean_panel(readings(spark, folder), EVENTS, src.EVENT_MEASURES, "target", "value", "k")
    return scalars.with_calendar(clean, EVENTS.day, first_day(spark, folder))


def first_day(spark: SparkSession, folder: str):
    """Earliest target day, taken from the source rather than the grouped panel."""
    targets = readings(spark, folder).where(F.col("modality") == "target")
    return targets.agg(F.min(EVENTS.day)).scalar()


def split_panel(spark: SparkSession, folder: str) -> DataFrame:
    base = panel(spark, folder)
    return split.assign_split(base, split.subject_split(base, EVENTS), EVENTS)


def temporal_panel(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.add_past_features(split_panel(spark, folder), EVENTS)


# A second, larger panel: customers observed on the days of their orders.
ORDERS = PanelSpec(
    thresholds=(100_000.0, 200_000.0),
    groups={
        "volume": ("quantity_mean", "price_sum", "discount_std"),
        "returns": ("returned_lines", "accepted_lines", "neutral_lines"),
    },
)
ORDER_MEASURES = [
    Measure("quantity_mean", "line", "l_quantity", "mean"),
    Measure("price_sum", "line", "l_extendedprice", "sum"),
    Measure("discount_std", "line", "l_discount", "std"),
    Measure("returned_lines", "line", "l_returnflag", "level", "R"),
    Measure("accepted_lines", "line", "l_returnflag", "level", "A"),
    Measure("neutral_lines", "line", "l_returnflag", "level", "N"),
    Measure("device_score", "line", "l_tax", "mean"),
    Measure("device_flag", "line", "late", "any"),
]


def order_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as target readings, their lines as a second kind of reading.

    Lines are joined to the order's customer and day on the order key; both
    sides are large, so the choice of join is left to Spark's statistics.
    """
    orders = src.table(spark, folder, "orders")
    owner = orders.select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").cast("string").alias(ORDERS.subject),
        F.to_date("o_orderdate").alias(ORDERS.day),
    )
    targets = orders.select(
        F.col("o_custkey").cast("string").alias(ORDERS.subject),
        F.to_date("o_orderdate").alias(ORDERS.day),
        F.lit("target").alias("modality"),
        F.col("o_totalprice"),
        F.length("o_orderpriority").cast("double").alias("priority"),
    )
    lines = (
        src.table(spark, folder, "lineitem")
        .select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
        .join(owner, "l_orderkey")
        .select(
            ORDERS.subject,
            ORDERS.day,
            F.lit("line").alias("modality"),
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
            "l_returnflag",
            (F.datediff(F.col("l_shipdate"), F.col(ORDERS.day)) > 90).alias("late"),
        )
    )
    return targets.unionByName(lines, allowMissingColumns=True)


def order_panel(spark: SparkSession, folder: str) -> DataFrame:
    return daily.clean_panel(
        order_readings(spark, folder), ORDERS, ORDER_MEASURES, "target", "o_totalprice", "priority"
    )
