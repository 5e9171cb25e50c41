"""From folders of reading files to audited, split and evaluated tables.

Each stage reads tables and writes tables; a stage can be re-run alone.  All
tables of a stage come from the same lazily built frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions import scalars
from panelloom.models import evaluate, robustness, tuning
from panelloom.models.families import FAMILIES, FIXED, UNTUNED, Family
from panelloom.operators import clean, compare, coverage, daily, profile, split, temporal, validate
from panelloom.operators.profile import long_metrics
from panelloom.sources import files, tables
from panelloom.sources import readings as src
from panelloom.spec import WEARABLE, PanelSpec, ablation_groups, deviation_conditions, temporal_conditions

MODEL_COLUMNS = (
    T.StructField("semester_week", T.IntegerType()),
    T.StructField("day_of_week", T.IntegerType()),
    T.StructField("is_weekend", T.IntegerType()),
    T.StructField("split", T.StringType()),
)
TARGET = (src.TARGET_MODALITY, f"{src.TARGET_MODALITY}__stress", f"{src.TARGET_MODALITY}__anxiety")


def raw_audit(spark: SparkSession, root: str, out: str, spec: PanelSpec = WEARABLE) -> None:
    """Stage 00: files, coverage of target days, availability, questionnaire.

    The files are parsed once; everything else reads the readings as landed.
    """
    tables.write_table(src.file_readings(spark, root, spec), f"{out}/readings", ("modality",))
    readings = spark.read.parquet(f"{out}/readings")
    present = files.list_files(spark, root, spec.subject)
    values = {m: [f"{m}__{c}" for c in files.value_columns(m)] for m in files.MODALITIES}
    flags = coverage.day_flags(readings, spec.key, files.MODALITIES, *TARGET[:2])
    covered = coverage.target_coverage(flags, spec.subject, files.MODALITIES, TARGET[0])
    audit = coverage.modality_audit(readings, spec.subject, spec.day, values, present)
    tables.write_table(audit, f"{out}/modality_audit")
    tables.write_table(covered, f"{out}/target_coverage")
    covered = spark.read.parquet(f"{out}/target_coverage")
    tables.write_table(coverage.coverage_summary(covered, spec.subject), f"{out}/coverage_summary")
    available = coverage.subject_availability(
        flags, spec.subject, files.MODALITIES, files.WEARABLE_MODALITIES, TARGET[0], present
    )
    tables.write_table(available, f"{out}/availability")
    audit, available = (spark.read.parquet(f"{out}/{name}") for name in ("modality_audit", "availability"))
    tables.write_audit(long_metrics(coverage.audit_summary(available)), f"{out}/summary")
    tables.write_table(coverage.missing_files(audit), f"{out}/missing_files")
    answers = daily.target_rows(readings, spec, *TARGET)
    tables.write_audit(long_metrics(profile.target_audit(answers, spec)), f"{out}/target_audit")


def build(
    spark: SparkSession,
    root: str,
    out: str,
    spec: PanelSpec = WEARABLE,
    earlier: DataFrame | None = None,
    readings: DataFrame | None = None,
) -> None:
    """Stage 01: one row per answer with all daily columns, and its audit.

    ``earlier`` is a previous version of the table to compare with; ``readings``
    are those that stage 00 has landed, if it ran.
    """
    readings = src.file_readings(spark, root, spec) if readings is None else readings
    rows = daily.subject_day_rows(readings, spec, src.FILE_MEASURES, *TARGET)
    tables.write_table(rows, f"{out}/subject_day_rows", order=spec.key)
    stored = spark.read.parquet(f"{out}/subject_day_rows")
    tables.write_audit(long_metrics(profile.panel_audit(stored, spec)), f"{out}/build_audit")
    if earlier is not None:
        versions = compare.table_compare(earlier, stored, spec.key, [spec.target, spec.secondary])
        tables.write_audit(long_metrics(versions), f"{out}/version_audit")


def cleaning(spark: SparkSession, source: str, out: str, spec: PanelSpec = WEARABLE) -> None:
    """Stage 02: unique subject-days, profile of what was repeated, audit."""
    rows = spark.read.parquet(f"{source}/subject_day_rows")
    tables.write_table(clean.resolve_duplicates(rows, spec), f"{out}/panel", order=spec.key)
    tables.write_table(clean.duplicate_conflicts(rows, spec), f"{out}/duplicate_conflicts")
    panel = spark.read.parquet(f"{out}/panel")
    tables.write_audit(
        long_metrics(profile.panel_audit(panel, spec)).unionByName(long_metrics(clean.duplicate_summary(rows, spec))),
        f"{out}/clean_audit",
    )


def model_data(
    spark: SparkSession, source: str, out: str, spec: PanelSpec = WEARABLE, assignments: DataFrame | None = None
) -> None:
    """Stage 03: calendar, split by subject, column sets.

    ``assignments`` (subject, split) replaces the hash split if given.
    """
    panel = scalars.with_calendar(spark.read.parquet(f"{source}/panel"), spec.day)
    chosen = assignments if assignments is not None else split.subject_split(panel, spec)
    tables.write_table(split.assign_split(panel, chosen, spec), f"{out}/model_table", ("split",))
    table = spark.read.parquet(f"{out}/model_table")
    split.require_whole_subjects(table, spec)
    tables.write_table(split.split_integrity(table, spec), f"{out}/split_assignments")
    tables.write_table(profile.split_summary(table, spec), f"{out}/split_summary")
    sets = {
        "excluded_inputs": spec.forbidden_inputs,
        "all_wearable": spec.features,
        "feature_groups": ablation_groups(spec),
        "temporal_conditions": temporal_conditions(spec),
    }
    tables.write_column_sets(spark, sets, f"{out}/column_sets")


def description(spark: SparkSession, source: str, out: str, spec: PanelSpec = WEARABLE) -> None:
    """The descriptive tables of the model table."""
    panel = spark.read.parquet(f"{source}/model_table")
    weekly = profile.weekly_trend(panel, spec)
    correlations = profile.spearman(panel, spec.target, spec.features, 20)
    results = {
        "label_distribution": profile.label_distribution(panel, spec),
        "subject_profile": profile.subject_profile(panel, spec),
        "split_summary": profile.split_summary(panel, spec),
        "missing_by_feature": profile.missing_by_feature(panel, spec.features),
        "missing_by_group": profile.missing_by_group(panel, spec.groups),
        "label_threshold_check": profile.target_by_label(panel, spec.target, spec.label),
        "feature_description": profile.describe_features(panel, spec.features),
        "feature_by_label": profile.feature_by_label(panel, spec.features, spec.label),
        "spearman": correlations,
        "outliers": profile.iqr_outliers(panel, spec.features),
        "weekly": weekly,
        "weekly_band": profile.weekly_band(weekly),
        "extreme_weeks": profile.extreme_weeks(weekly),
        "weekday_weekend": profile.weekday_weekend(panel, spec),
        "score_histogram": profile.histogram_fixed(panel, spec.target),
        "feature_histograms": profile.histogram_equal_width(panel, spec.features),
        "standardised_means": profile.standardised_means(panel, spec.features, spec.label),
        "dataset_summary": profile.dataset_summary(panel, spec),
    }
    for name, frame in results.items():
        tables.write_table(frame, f"{out}/{name}")


def model_comparison(
    spark: SparkSession,
    source: str,
    out: str,
    spec: PanelSpec = WEARABLE,
    chosen: dict[str, Family] | None = None,
    folds: int = 5,
) -> None:
    """Stages 04 to 06 and the deviation experiment: tuned comparisons."""
    panel = spark.read.parquet(f"{source}/model_table")
    featured = temporal.add_past_features(panel, spec)
    conditions = temporal_conditions(spec)
    validate.require_unique_key(panel, spec)
    validate.require_temporal_design(featured, conditions, spec)
    experiments = {
        "models": {"all_wearable": spec.features},
        "feature_groups": ablation_groups(spec),
        "temporal": conditions,
        "deviation": deviation_conditions(spec),
    }
    for name, (results, matrices) in tuning.run_experiments(featured, spec, experiments, chosen, folds).items():
        tables.write_table(results, f"{out}/{name}_results")
        tables.write_table(tuning.best_per_condition(results), f"{out}/{name}_best")
        tables.write_table(tuning.best_overall(results), f"{out}/{name}_best_overall")
        tables.write_table(matrices, f"{out}/{name}_confusion")


def untuned_comparison(
    spark: SparkSession, source: str, out: str, features: list[str], spec: PanelSpec = WEARABLE,
    settings: dict[str, dict] | None = None,
) -> None:
    """The older comparison: default settings, features without nulls required."""
    panel = spark.read.parquet(f"{source}/model_table")
    validate.require_no_nulls(panel, features, "model table")
    train, test = split.split_parts(panel)
    frames = {
        name: tuning.fit_predict(train, test, spec, features, FAMILIES[name], params)
        for name, params in (settings or UNTUNED).items()
    }
    scored = evaluate.evaluate(compare.union_conditions(frames, "model"), ["model"])
    tables.write_table(scored, f"{out}/untuned_results")


def robustness_checks(
    spark: SparkSession,
    source: str,
    out: str,
    spec: PanelSpec = WEARABLE,
    fixed: dict[str, tuple[str, dict, str]] | None = None,
    draws: int = 2000,
) -> None:
    """Stage 07: fixed configurations, bootstrap over subjects, leave one out."""
    stored = spark.read.parquet(f"{source}/model_table")
    validate.require_unique_key(stored, spec)
    panel = temporal.add_past_features(stored, spec)
    train, test = split.split_parts(panel)
    sets = {**ablation_groups(spec), **temporal_conditions(spec)}
    frames, left_out = {}, {}
    for name, (family, params, columns) in (fixed or FIXED).items():
        frames[name] = tuning.fit_predict(train, test, spec, sets[columns], FAMILIES[family], params)
        left_out[name] = tuning.leave_one_subject_out(train, spec, sets[columns], FAMILIES[family], params)
    tables.write_table(compare.union_conditions(frames, "analysis"), f"{out}/predictions")
    predictions = spark.read.parquet(f"{out}/predictions")
    resampled = robustness.bootstrap_draws(predictions, spec.subject, ["analysis"], draws)
    tables.write_table(resampled, f"{out}/bootstrap_draws")
    points = evaluate.evaluate(predictions, ["analysis"])
    stored = spark.read.parquet(f"{out}/bootstrap_draws")
    tables.write_table(robustness.bootstrap_summary(stored, points, ["analysis"]), f"{out}/bootstrap_summary")
    folds = compare.union_conditions(left_out, "analysis")
    tables.write_table(folds, f"{out}/leave_one_out_folds")
    tables.write_table(robustness.subject_score_summary(folds, ["analysis"]), f"{out}/leave_one_out_summary")


def labelled(frame: DataFrame, spec: PanelSpec = WEARABLE) -> DataFrame:
    """Rebuild the label of a loaded table from its target."""
    return frame.withColumn(spec.label, scalars.band(F.col(spec.target), spec.thresholds))


def data_stages(spark: SparkSession, root: str, out: str, spec: PanelSpec = WEARABLE) -> None:
    """Stages 00 to 03 and the descriptive tables, in order."""
    raw_audit(spark, root, f"{out}/audit", spec)
    build(spark, root, f"{out}/build", spec, readings=spark.read.parquet(f"{out}/audit/readings"))
    cleaning(spark, f"{out}/build", f"{out}/clean", spec)
    model_data(spark, f"{out}/clean", f"{out}/model", spec)
    description(spark, f"{out}/model", f"{out}/description", spec)
