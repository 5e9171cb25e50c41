"""The clean panel kept up to date, step by step, from files that are new or changed.

A store holds three tables, each with one folder a step:

* ``manifest``: every file with its length, time of change, checksum, and the step
  that holds its states; a file that is gone has an entry that says so;
* ``states``: per file and (subject, day) what the daily columns can be merged
  from: counts, sums, sums of squared deviations, any-true;
* ``panel``: the rows whose (subject, day) a step touched, as they are from then on.

A step lists the folder, reads the files whose length or time differ from the
manifest, and parses those whose checksum differs too. It merges the states of all
files, old and new, for the touched (subject, day) pairs only. The manifest is
written last, which makes the step valid: what a step that was cut off has left is
not read, and the next one writes over it. One step at a time may run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions import scalars
from panelloom.session import cut_lineage
from panelloom.sources import files
from panelloom.sources import readings as src
from panelloom.sources.readings import Measure
from panelloom.spec import WEARABLE, PanelSpec

ANSWERS = "_answers"


def state_columns(measure: Measure) -> dict[str, Column]:
    """What a daily column is merged from, over a group that mixes all kinds."""
    own = F.col("modality") == measure.modality
    source = F.col(measure.source)
    value = F.when(own, source)
    if measure.how == "any":
        return {"any": F.bool_or(value)}
    if measure.how == "level":
        return {"days": F.count_if(own & source.isNotNull()), "hits": F.count_if(own & (source == measure.level))}
    found = {"n": F.count(value), "sum": F.sum(value)}
    if measure.how == "std":
        found["squares"] = F.var_pop(value) * F.count(value)
    if measure.how == "sum":
        found["days"] = F.count_if(own)
    elif measure.how not in ("mean", "std"):
        raise ValueError(f"unknown aggregate {measure.how!r}")
    return found


def merged_column(measure: Measure) -> Column:
    """The daily column from the states of a group."""
    part = lambda name: F.col(f"{measure.out}__{name}")
    if measure.how == "any":
        return F.bool_or(part("any"))
    if measure.how == "level":
        return F.when(F.sum(part("days")) > 0, F.sum(part("hits")).cast("double"))
    total, n = F.sum(part("sum")), F.sum(part("n"))
    if measure.how == "sum":
        return F.when(F.sum(part("days")) > 0, F.coalesce(total, F.lit(0.0)))
    mean = F.when(n > 0, total / n)
    if measure.how == "mean":
        return mean
    # Within the files, and between their means; the latter is 0 for a single file.
    squared = F.when(part("n") > 0, part("sum") * part("sum") / part("n"))
    between = F.sum(squared) - total * total / F.when(n > 0, n)
    return F.when(n > 1, F.sqrt(F.greatest(F.sum(part("squares")) + between, F.lit(0.0)) / (n - 1)))


def daily_states(readings: DataFrame, by: Sequence[str], measures: Sequence[Measure], target: str) -> DataFrame:
    """States of all measures per group; rows without a subject or day take no part."""
    states = [c.alias(f"{m.out}__{name}") for m in measures for name, c in state_columns(m).items()]
    answers = F.count_if(F.col("modality") == target).alias(ANSWERS)
    return readings.groupBy(*by).agg(answers, *states)


def merge_states(states: DataFrame, spec: PanelSpec, measures: Sequence[Measure]) -> DataFrame:
    """Clean subject-days: those with an answer, by any number of states each."""
    return (
        states.groupBy(*spec.key)
        .agg(F.sum(ANSWERS).alias(ANSWERS), *[merged_column(m).alias(m.out) for m in measures])
        .where(F.col(ANSWERS) > 0)
        .withColumn(spec.label, scalars.band(F.col(spec.target), spec.thresholds))
        .select(*spec.columns)
    )


def panel_measures(spec: PanelSpec, score: str, secondary: str) -> list[Measure]:
    target = src.TARGET_MODALITY
    return [Measure(spec.target, target, score, "mean"), Measure(spec.secondary, target, secondary, "mean"), *src.FILE_MEASURES]


def _steps(spark: SparkSession, store: str) -> tuple[int, DataFrame | None]:
    """The last valid step and the newest entry of every file."""
    try:
        entries = spark.read.parquet(f"{store}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None
    columns = [c for c in entries.columns if c not in ("path", "step")]
    newest = entries.groupBy("path").agg(F.max_by(F.struct(*columns), "step").alias("entry")).select("path", "entry.*")
    return entries.agg(F.max("step")).first()[0], newest.where(~F.col("gone"))


ENTRY = "path string, length bigint, modified timestamp, checksum decimal(38,0), lines bigint, states_step int, gone boolean"


def update(spark: SparkSession, root: str, store: str, spec: PanelSpec = WEARABLE) -> dict[str, int]:
    """Bring the store up to the files under ``root``.

    Returns the step and the numbers of files listed, read, parsed and gone. The
    paths of files to read come to the driver, which has to list them anyway.
    """
    target = src.TARGET_MODALITY
    measures = panel_measures(spec, f"{target}__stress", f"{target}__anxiety")
    last, known = _steps(spark, store)
    known = cut_lineage(spark.createDataFrame([], ENTRY) if known is None else known)
    listed = cut_lineage(files.list_files(spark, root, spec.subject))
    old = known.select("path", *[F.col(c).alias(f"_{c}") for c in ("length", "modified", "checksum", "lines", "states_step")])
    differs = ~(F.col("length").eqNullSafe(F.col("_length")) & F.col("modified").eqNullSafe(F.col("_modified")))
    suspects = cut_lineage(listed.join(old, "path", "left").where(differs))
    gone = known.join(listed, "path", "left_anti")
    paths = [r.path for r in suspects.select("path").toLocalIterator()]
    counts = {"step": last, "listed": listed.count(), "read": len(paths), "parsed": 0, "gone": gone.count()}
    if not paths and not counts["gone"]:
        return counts

    step = counts["step"] = last + 1
    empty = spark.createDataFrame([], "path string, header string, lines bigint, checksum decimal(38,0)")
    facts = files.line_facts(spark, paths) if paths else empty
    seen = suspects.join(facts.withColumn("checksum", F.col("checksum").cast("decimal(38,0)")), "path", "left")
    same = F.col("checksum").eqNullSafe(F.col("_checksum")) & F.col("lines").eqNullSafe(F.col("_lines"))
    # A file first seen is new even if it holds no line.
    seen = cut_lineage(seen.withColumn("changed", F.col("_states_step").isNull() | ~same))
    headers: dict[str, files.Headers] = {}
    for row in seen.where("changed").select("path", "modality", "header").toLocalIterator():
        counts["parsed"] += 1
        if row.header is not None:
            headers.setdefault(row.modality, {}).setdefault(files.column_names(row.header), []).append(row.path)

    dated = F.col(spec.subject).isNotNull() & F.col(spec.day).isNotNull()
    fresh = daily_states(src.readings_of(spark, headers, spec).where(dated), ["path", *spec.key], measures, target)
    fresh.sortWithinPartitions(*spec.key).write.mode("overwrite").parquet(f"{store}/states/step={step}")

    entries = seen.select(
        "path", "length", "modified", "checksum", "lines",
        F.when(F.col("changed"), step).otherwise(F.col("_states_step")).cast("int").alias("states_step"),
        F.lit(False).alias("gone"),
    ).unionByName(gone.withColumn("gone", F.lit(True)))
    entries = cut_lineage(entries)
    states = spark.read.parquet(f"{store}/states").where(F.col("step") <= step)
    # States that counted so far and no longer do, and those that now do.
    moved = seen.where("changed").select("path").unionByName(gone.select("path"))
    before = known.join(moved, "path", "left_semi").select("path", F.col("states_step").alias("step"))
    now = entries.where("NOT gone").select("path", F.col("states_step").alias("step"))
    now = cut_lineage(known.join(entries, "path", "left_anti").select("path", F.col("states_step").alias("step")).unionByName(now))
    touched = states.where(F.col("step") == step).select(*spec.key)
    touched = cut_lineage(
        touched.unionByName(states.join(before, ["path", "step"], "left_semi").select(*spec.key)).distinct()
    )
    current = states.join(touched, spec.key, "left_semi").join(now, ["path", "step"], "left_semi")
    rows = merge_states(current, spec, measures).withColumn("_there", F.lit(True))
    rows = touched.join(rows, spec.key, "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    rows.write.mode("overwrite").parquet(f"{store}/panel/step={step}")
    entries.write.mode("overwrite").parquet(f"{store}/manifest/step={step}")
    return counts


def panel(spark: SparkSession, store: str, spec: PanelSpec = WEARABLE) -> DataFrame:
    """The panel as of the last valid step: the newest row of every (subject, day)."""
    last, _ = _steps(spark, store)
    rows = spark.read.parquet(f"{store}/panel").where(F.col("step") <= last)
    values = [c for c in rows.columns if c not in (*spec.key, "step")]
    newest = rows.groupBy(*spec.key).agg(F.max_by(F.struct(*values), "step").alias("row"))
    return newest.where("row._there").select(*[c if c in spec.key else F.col(f"row.{c}").alias(c) for c in spec.columns])
