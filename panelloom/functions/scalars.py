"""Column expressions. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.spec import LABELS, LOW_MAX, MEDIUM_MAX


# Seconds that fit a 64-bit count of nanoseconds around 1970; others are not dates.
UNIX_LIMIT = 9_223_372_036.0
# Notations besides ISO 8601, month before day, tried in this order.
NOTATIONS = (
    "M/d/yyyy H:m[:s][.SSS]",
    "M/d/yyyy h:m[:s] a",
    "M/d/yyyy",
    "yyyy/M/d H:m[:s]",
    "yyyy/M/d",
    "MMM d yyyy H:m[:s]",
    "MMM d yyyy",
    "MMM d, yyyy H:m[:s]",
    "MMM d, yyyy",
    "d MMM yyyy H:m[:s]",
    "d MMM yyyy",
    "yyyyMMdd HHmmss",
)


def unix_day(seconds: Column) -> Column:
    """UTC date of unix seconds; unreadable and absurd values give null."""
    value = seconds.try_cast("double")
    whole = F.when(F.abs(value) <= UNIX_LIMIT, F.floor(value / 86400)).try_cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), whole)


def lenient_day(text: Column, patterns: Sequence[str] = NOTATIONS) -> Column:
    """UTC date of a timestamp in mixed notation; unreadable values give null."""
    trimmed = F.trim(text)
    digits = F.when(trimmed.rlike("^[0-9]{8}$"), F.try_to_timestamp(trimmed, F.lit("yyyyMMdd")))
    attempts = [F.try_to_timestamp(trimmed)]
    attempts += [F.try_to_timestamp(trimmed, F.lit(p)) for p in patterns]
    return F.to_date(F.coalesce(digits, *attempts))


def band(
    score: Column,
    thresholds: Sequence[float] = (LOW_MAX, MEDIUM_MAX),
    labels: Sequence[str] = LABELS,
) -> Column:
    """Label by upper thresholds, each inclusive. A null score has no label."""
    expression = F.when(score.isNull(), F.lit(None).cast("string"))
    for limit, label in zip(thresholds, labels):
        expression = expression.when(score <= limit, label)
    return expression.otherwise(labels[-1])


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, zero where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0))


def number(text: Column) -> Column:
    """Lenient conversion to double; unreadable values and NaN give null."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def join_values(values: Column) -> Column:
    """Array of values as one text, separated by '; '."""
    return F.concat_ws("; ", F.transform(values, lambda v: v.cast("string")))


def day_type(weekday: Column) -> Column:
    return F.when(weekday >= 5, "weekend").otherwise("weekday")


def single(frame: DataFrame, *columns: Column) -> Column:
    """One-row frame as a struct-valued scalar subquery.

    Spark fails the job if the frame has a second row, so this can never grow
    into a join the way a broadcast product could.
    """
    return frame.select(F.struct(*(columns or ["*"]))).scalar()


def with_calendar(frame: DataFrame, day: str, origin: Column | None = None) -> DataFrame:
    """Week counted from the earliest day of the whole table, weekday, weekend."""
    if origin is None:
        origin = frame.agg(F.min(day)).scalar()
    weekday = F.weekday(F.col(day))
    return frame.withColumns(
        {
            "semester_week": (F.floor(F.datediff(F.col(day), origin) / 7) + 1).cast("int"),
            "day_of_week": weekday.cast("int"),
            "is_weekend": (weekday >= 5).cast("int"),
        }
    )


def rounded(frame: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Presentation only: round every double column, after adding ``nudge``."""
    return frame.select(
        *[
            F.round(F.col(f"`{name}`") + nudge, digits).alias(name) if kind == "double" else F.col(f"`{name}`")
            for name, kind in frame.dtypes
        ]
    )


def half_even(value: Column, digits: int) -> Column:
    """Presentation rounding that sends ties to the even digit."""
    return F.bround(value, digits)
