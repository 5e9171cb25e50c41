"""Order statistics that never bring a whole column into one task.

A value is placed in a cell by its sign, binary exponent and the first bits of
its mantissa.  That placement depends on the value alone, keeps the order of
the values, and therefore gives the same answer in every branch of a plan and
in every re-run of a lost task, without sampling.  Counts per cell are tiny, so
the rank at which each cell starts is known before any value is sorted; only
the cells a question touches are then looked at value by value.

A column whose magnitudes span a factor of a million has about 20 exponents and
hence 20 * 2 ** CELL_BITS = 82,000 cells, whatever its number of rows. A narrow
column may fall into a single cell, so cells are divided again by the next
INNER_BITS of the mantissa: no window sees more than 2 ** INNER_BITS counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelloom.session import cut_lineage

CELL_BITS = 12
INNER_BITS = 20
# Doubles have exponents from -1074 to 1023; shifted, all of them are positive.
_SHIFT = 1100


def cell_of(value: Column) -> Column:
    """Cell number of a value: larger values never have a smaller cell."""
    exponent = F.floor(F.log2(F.abs(value)))
    part = F.floor((F.abs(value) / F.pow(F.lit(2.0), exponent) - 1) * (1 << CELL_BITS))
    cell = (exponent + _SHIFT) * (2 << CELL_BITS) + part
    return F.when(value > 0, cell).when(value < 0, -cell).otherwise(F.lit(0)).cast("bigint")


def inner_of(value: Column) -> Column:
    """Place inside the cell by the next bits, ascending with the value."""
    exponent = F.floor(F.log2(F.abs(value)))
    scaled = (F.abs(value) / F.pow(F.lit(2.0), exponent) - 1) * (1 << CELL_BITS)
    inner = F.floor((scaled - F.floor(scaled)) * (1 << INNER_BITS))
    return F.when(value > 0, inner).when(value < 0, -inner).otherwise(F.lit(0)).cast("bigint")


def _within_cells(histogram: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Add ``before``: entries of (keys..., cell) ahead of each distinct value.

    Entries are summed per inner cell first, so that only values of one inner
    cell meet in a window.
    """
    inner = histogram.withColumn("_inner", inner_of(F.col(value)))
    ahead = Window.partitionBy(*keys, "cell").orderBy("_inner").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        inner.groupBy(*keys, "cell", "_inner")
        .agg(F.sum("n").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
        .drop("_n")
    )
    place = Window.partitionBy(*keys, "cell", "_inner").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        inner.withColumn("_place", F.coalesce(F.sum("n").over(place), F.lit(0)))
        .join(starts, [*keys, "cell", "_inner"])
        .withColumn("before", F.col("_start") + F.col("_place"))
        .drop("_inner", "_start", "_place")
    )


def melt(frame: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long form (by..., feature, value) of numeric columns, nulls left out."""
    return (
        frame.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot(list(by), list(columns), "feature", "value")
        .where(F.col("value").isNotNull())
    )


def _cell_starts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of entries ahead of each cell, and in total.

    The windows run over counts, one row per occupied cell.
    """
    whole = Window.partitionBy(*keys)
    ahead = whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *keys,
        "cell",
        F.col("n").alias("n_cell"),
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before_cell"),
        F.sum("n").over(whole).alias("total"),
    )


def quantiles(
    frame: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact quantiles with linear interpolation, (by..., feature, share, quantile).

    First pass: counts per cell, which combine map-side to a few thousand rows.
    Second pass: only values of the cells that hold a wanted rank, which for
    each feature and share are at most two. How that small set is joined is
    left to Spark, which measures it.
    """
    keys = [*by, "feature"]
    cells = melt(frame, columns, by).withColumn("cell", cell_of(F.col("value")))
    starts = _cell_starts(cells.groupBy(*keys, "cell").agg(F.count("*").alias("n")), keys)
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    targets = (
        starts.withColumn("share", F.explode(wanted))
        .withColumn("position", F.col("share") * (F.col("total") - 1))
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("position"), F.ceil("position")))))
        .where(
            (F.col("rank") >= F.col("before_cell"))
            & (F.col("rank") < F.col("before_cell") + F.col("n_cell"))
        )
        .select(*keys, "cell", "before_cell", "share", "position", "rank")
    )
    touched = targets.select(*keys, "cell").distinct()
    counted = (
        cells.join(touched, [*keys, "cell"], "left_semi")
        .groupBy(*keys, "cell", "value")
        .agg(F.count("*").alias("n"))
    )
    first = F.col("before_cell") + F.col("before")
    hit = _within_cells(counted, keys).join(targets, [*keys, "cell"]).where(
        (F.col("rank") >= first) & (F.col("rank") < first + F.col("n"))
    )
    # At most two hits per group: the values at the ranks around the position.
    fraction = F.max(F.col("position") - F.floor("position"))
    low, high = F.min("value"), F.max("value")
    return hit.groupBy(*keys, "share").agg((low * (1 - fraction) + high * fraction).alias("quantile"))


def medians_without(frame: DataFrame, columns: Sequence[str], group: str, outs: Sequence[int]) -> DataFrame:
    """Exact medians of the rows of all groups but one, (_out, feature, quantile), for a few of ``outs``.

    Rows are counted per group once and only the counts are repeated for each
    group left out. The cells that hold a median are at most two per feature
    and group left out, so their numbers go into the second pass as literals.
    """
    keys = ["_out", "feature"]
    lists = F.array(*[F.lit(o) for o in outs])

    def without(counts: DataFrame, *by: str) -> DataFrame:
        copies = counts.withColumn("_out", F.explode(F.filter(lists, lambda o: o != F.col(group))))
        return copies.groupBy(*keys, *by).agg(F.sum("n").alias("n"))

    cells = melt(frame, columns, [group]).withColumn("cell", cell_of(F.col("value")))
    starts = _cell_starts(without(cells.groupBy(group, "feature", "cell").agg(F.count("*").alias("n")), "cell"), keys)
    position = 0.5 * (F.col("total") - 1)
    targets = cut_lineage(
        starts.withColumn("position", position)
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("position"), F.ceil("position")))))
        .where((F.col("rank") >= F.col("before_cell")) & (F.col("rank") < F.col("before_cell") + F.col("n_cell")))
        .select(*keys, "cell", "before_cell", "position", "rank")
    )
    touched: dict[str, set[int]] = {}
    for r in targets.select("feature", "cell").distinct().collect():
        touched.setdefault(r["feature"], set()).add(r["cell"])
    if not touched:
        return targets.select(*keys, F.lit(None).cast("double").alias("quantile"))
    # One look-up, in which the cell of a value is worked out once.
    table = F.create_map(*[x for f, n in touched.items() for x in (F.lit(f), F.array(*[F.lit(c) for c in sorted(n)]))])
    wanted = F.array_contains(table[F.col("feature")], F.col("cell"))
    counted = cells.where(wanted).groupBy(group, "feature", "cell", "value").agg(F.count("*").alias("n"))
    first = F.col("before_cell") + F.col("before")
    hit = _within_cells(without(counted, "cell", "value"), keys).join(targets, [*keys, "cell"]).where(
        (F.col("rank") >= first) & (F.col("rank") < first + F.col("n"))
    )
    fraction = F.max(F.col("position") - F.floor("position"))
    low, high = F.min("value"), F.max("value")
    return hit.groupBy(*keys).agg((low * (1 - fraction) + high * fraction).alias("quantile"))


def quantile_columns(long: DataFrame, names: dict[float, str], by: Sequence[str] = ()) -> DataFrame:
    """Shares of a quantile table side by side, one row per (by..., feature)."""
    return long.groupBy(*by, "feature").agg(
        *[F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(n) for s, n in names.items()]
    )


def ranked(histogram: DataFrame, keys: Sequence[str], value: str = "value", counts: Sequence[str] = ("n",)) -> DataFrame:
    """A histogram (keys..., value, counts...) with ``rank_c`` and ``total_c`` for each count c.

    Ranks count from one and ties share their mean, so a value with ``b``
    entries ahead of it and ``n`` of its own has rank ``b + (n + 1) / 2``.
    Only cells of more than 2 ** INNER_BITS values are divided again.
    """
    cells = histogram.withColumn("cell", cell_of(F.col(value)))
    ahead = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    known = cells.groupBy(*keys, "cell").agg(F.count("*").alias("_kinds"), *[F.sum(c).alias(f"_in_{c}") for c in counts])
    known = known.select(
        *keys,
        "cell",
        (F.col("_kinds") > (1 << INNER_BITS)).alias("_crowded"),
        *[F.coalesce(F.sum(f"_in_{c}").over(ahead), F.lit(0)).alias(f"_before_{c}") for c in counts],
        *[F.sum(f"_in_{c}").over(whole).alias(f"total_{c}") for c in counts],
    )
    inner = F.when(F.col("_crowded"), inner_of(F.col(value))).otherwise(F.lit(0))
    placed = cells.join(known, [*keys, "cell"]).withColumn("_inner", inner)
    part = Window.partitionBy(*keys, "cell").orderBy("_inner").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.where("_crowded")
        .groupBy(*keys, "cell", "_inner")
        .agg(*[F.sum(c).alias(f"_in_{c}") for c in counts])
        .select(*keys, "cell", "_inner", *[F.sum(f"_in_{c}").over(part).alias(f"_start_{c}") for c in counts])
    )
    place = Window.partitionBy(*keys, "cell", "_inner").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)

    def rank(c: str) -> Column:
        return F.col(f"_before_{c}") + F.coalesce(f"_start_{c}", F.lit(0)) + F.coalesce(f"_place_{c}", F.lit(0)) + (F.col(c) + 1) / 2

    return (
        placed.withColumns({f"_place_{c}": F.sum(c).over(place) for c in counts})
        .join(starts, [*keys, "cell", "_inner"], "left")
        .select(*histogram.columns, *[rank(c).alias(f"rank_{c}") for c in counts], *[f"total_{c}" for c in counts])
    )


def average_ranks(histogram: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Average rank of each distinct value from (keys..., value, n)."""
    found = ranked(histogram.select(*keys, value, "n"), keys, value)
    return found.select(*keys, value, "n", F.col("rank_n").alias("avg_rank"), F.col("total_n").alias("total"))


def hash_order(*parts: Column) -> Column:
    """Text whose order is a reproducible shuffle of the given identity."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def hash_integer(text: Column, digits: int = 8) -> Column:
    """Leading hex digits of a text as an integer."""
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("bigint")


def with_hash_ordinal(
    frame: DataFrame,
    identity: Sequence[str],
    seed: int,
    within: Sequence[str] = (),
    prefix: int = 3,
    name: str = "ordinal",
) -> DataFrame:
    """Number rows 0, 1, 2, ... by hash order, separately in each ``within`` group.

    A plain ``row_number`` would sort a whole class in one task.  Here the
    leading hex digits split each class into 16 ** prefix even parts; the parts
    are counted, the counts summed up, and only rows of a part are sorted.
    """
    spread = frame.withColumn("_h", hash_order(F.lit(seed), *[F.col(c) for c in identity]))
    spread = spread.withColumn("_part", F.substring("_h", 1, prefix))
    ahead = (
        Window.partitionBy(*(within or [F.lit(0)]))
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    parts = (
        spread.groupBy(*within, "_part")
        .agg(F.count("*").alias("_n"))
        .withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
        .drop("_n")
    )
    place = Window.partitionBy(*within, "_part").orderBy("_h", *identity)
    return (
        spread.withColumn("_place", F.row_number().over(place) - 1)
        .join(parts, [*within, "_part"])
        .withColumn(name, (F.col("_ahead") + F.col("_place")).cast("bigint"))
        .drop("_h", "_part", "_ahead", "_place")
    )


def with_sorted_ordinal(frame: DataFrame, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Number rows 0, 1, 2, ... in sort order, for any sortable type.

    A distributed sort gives every row its place inside its partition.  The
    result is checkpointed, so that counting the partitions and reading the
    rows see the same partitions; the counts are one row per partition.
    """
    sorted_rows = cut_lineage(frame.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    placed = sorted_rows.withColumns(
        {"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    ahead = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
        .drop("_n")
    )
    return (
        placed.join(parts, "_part")
        .withColumn(name, F.col("_ahead") + F.col("_place"))
        .drop("_id", "_part", "_place", "_ahead")
    )
