"""Splits and folds by hash order.

A subject's place depends only on its id and the seed, so splits do not change
with partitioning, re-runs or row order.  A pseudo-random library stream is not
reproduced; a given assignment table can be attached instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions import ordering
from panelloom.operators.profile import label_counts
from panelloom.spec import SEED, TEST_SHARE, PanelSpec


def subject_table(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    return panel.groupBy(spec.subject).agg(F.count("*").alias("n_rows"), *label_counts(spec.label))


def subject_split(panel: DataFrame, spec: PanelSpec, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Subjects with split and counts; exactly ceil(share * subjects) are test."""
    subjects = ordering.with_hash_ordinal(subject_table(panel, spec), [spec.subject], seed)
    total = panel.agg(F.count_distinct(spec.subject)).scalar()
    is_test = F.col("ordinal") < F.ceil(total * F.lit(share))
    return subjects.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("ordinal")


def hash_split(subject: Column, share: float = TEST_SHARE, seed: int = SEED) -> Column:
    """Split as a pure expression: about ``share`` of subjects, no shuffle."""
    point = ordering.hash_integer(ordering.hash_order(F.lit(seed), subject)) / F.lit(float(16**8))
    return F.when(point < share, "test").otherwise("train")


def assign_split(panel: DataFrame, assignments: DataFrame, spec: PanelSpec) -> DataFrame:
    """Attach a split table by subject; Spark broadcasts it if it is small."""
    return panel.join(assignments.select(spec.subject, "split"), spec.subject, "left")


def split_parts(panel: DataFrame, split: str = "split") -> tuple[DataFrame, DataFrame]:
    """Train and test rows; either being empty is an error."""
    train, test = panel.where(F.col(split) == "train"), panel.where(F.col(split) == "test")
    if train.isEmpty() or test.isEmpty():
        raise ValueError("both the train and the test split need rows")
    return train, test


def split_integrity(panel: DataFrame, spec: PanelSpec, split: str = "split") -> DataFrame:
    """Split of each subject, 'mixed' where its rows disagree."""
    lowest, highest = F.min(split), F.max(split)
    loose = F.count_if(F.col(split).isNull()) > 0
    verdict = F.when(loose | lowest.isNull() | (lowest != highest), "mixed").otherwise(lowest)
    return panel.groupBy(spec.subject).agg(verdict.alias("split"), F.count("*").alias("n_rows"))


def require_whole_subjects(panel: DataFrame, spec: PanelSpec, split: str = "split") -> None:
    mixed = split_integrity(panel, spec, split).where(F.col("split") == "mixed")
    if not mixed.isEmpty():
        raise ValueError(f"subject {mixed.first()[0]!r} has rows in more than one split")


def hash_fold(subject: Column, folds: int, seed: int = SEED) -> Column:
    """Fold as a pure expression."""
    return F.pmod(ordering.hash_integer(ordering.hash_order(F.lit(seed), subject)), F.lit(folds)).cast("int")


def _greedy_plan(sizes: Sequence[tuple[int, int]], folds: int) -> list[tuple[int, list[int], list[int]]]:
    """For each subject size: folds of the first subjects, then a repeating cycle.

    Subjects of one size are interchangeable, so the greedy rule (largest first,
    into the lightest fold) is followed one by one only until the folds are
    level to within one such subject; from there it goes round in circles.
    """
    loads = [0] * folds
    plan = []
    for size, subjects in sorted(sizes, reverse=True):
        first: list[int] = []
        while len(first) < subjects and max(loads) - min(loads) >= size:
            fold = loads.index(min(loads))
            loads[fold] += size
            first.append(fold)
        cycle = sorted(range(folds), key=lambda f: (loads[f], f))
        rounds, rest = divmod(subjects - len(first), folds)
        for place, fold in enumerate(cycle):
            loads[fold] += size * (rounds + (place < rest))
        plan.append((size, first, cycle))
    return plan


def group_kfold(panel: DataFrame, spec: PanelSpec, folds: int = 5, seed: int = SEED) -> DataFrame:
    """Balanced folds of whole subjects: (subject, n_rows, fold).

    The driver sees only how many subjects have each size.  Sizes are numbers of
    days, so that histogram stays small however many subjects there are.
    """
    subjects = panel.groupBy(spec.subject).agg(F.count("*").alias("n_rows"))
    sizes = [(r.n_rows, r.n) for r in subjects.groupBy("n_rows").agg(F.count("*").alias("n")).collect()]
    total = sum(n for _, n in sizes)
    if total < 2:
        raise ValueError("folds by subject need at least two subjects")
    plan = panel.sparkSession.createDataFrame(
        _greedy_plan(sizes, min(folds, total)), "n_rows bigint, first array<int>, cycle array<int>"
    )
    place, lead = F.col("ordinal").cast("int"), F.size("first")
    fold = F.when(place < lead, F.get("first", place)).otherwise(
        F.get("cycle", F.pmod(place - lead, F.size("cycle")))
    )
    numbered = ordering.with_hash_ordinal(subjects, [spec.subject], seed, within=["n_rows"], prefix=2)
    return numbered.join(plan, "n_rows").select(spec.subject, "n_rows", fold.alias("fold"))


def leave_one_out_folds(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """One fold per subject, named by the subject itself."""
    return panel.withColumn("fold", F.col(spec.subject))


def stratified_kfold(
    rows: DataFrame, identity: Sequence[str], label: str, folds: int = 5, seed: int = SEED
) -> DataFrame:
    """Row-level folds with equal label shares."""
    numbered = ordering.with_hash_ordinal(rows, identity, seed, within=[label])
    return numbered.withColumn("fold", F.pmod("ordinal", F.lit(folds)).cast("int")).drop("ordinal")


def stratified_holdout(
    rows: DataFrame, identity: Sequence[str], label: str, share: float = 0.2, seed: int = SEED
) -> DataFrame:
    """Hold out the same share of every label, rounded to the nearest row."""
    numbered = ordering.with_hash_ordinal(rows, identity, seed, within=[label])
    sizes = rows.groupBy(label).agg(F.count("*").alias("_size"))
    held = F.col("ordinal") < F.floor(F.col("_size") * F.lit(share) + 0.5)
    return (
        numbered.join(sizes, label)
        .withColumn("part", F.when(held, "validation").otherwise("fit"))
        .drop("ordinal", "_size")
    )
