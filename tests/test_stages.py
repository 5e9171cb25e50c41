"""Folders of reading files through all data stages."""

import pytest

from panelloom.models import families, tuning
from panelloom.models.families import Family
from panelloom.plans import stages
from panelloom.sources import files, tables
from panelloom.sources import readings as src
from panelloom.spec import WEARABLE

HEADS = {m: ",".join(f.name for f in files.schema_of(m).fields) for m in files.MODALITIES}


def write(folder, modality, lines, bom=False):
    folder.mkdir(parents=True, exist_ok=True)
    text = "\n".join([HEADS[modality], *lines]) + "\n"
    (folder / f"{modality}.csv").write_text(text, encoding="utf-8-sig" if bom else "utf-8")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("raw")
    for s in range(1, 9):
        folder = base / str(s)
        asked = [f"0,0,{1704067200 + 86400 * d + 3600},0,0,0,0,{(s * 7 + d * 11) % 60},{d}" for d in range(12)]
        asked.append("0,0,bad,0,0,0,0,3,3")
        if s == 1:
            asked.append("0,0,1704067200,0,0,0,0,18,4")
        write(folder, "daily_questions", asked, bom=True)
        if s == 8:
            continue
        days = [f"2024-01-{d:02d}" for d in range(1, 11)]
        write(folder, "sleep", [f"{d}T06:00:00Z,{70 + s},{s}" for d in days])
        write(folder, "steps", [f"{d} 10:00:00,{s}" for d in days for _ in range(3)])
        write(folder, "activity_level", [f"{d} 10:00:00,SEDENTARY" for d in days])
        write(folder, "hrv", [f"{d} 10:00:00,{s},1,{s},2" for d in days])
        write(folder, "oxygen", [f"{d} 10:0{i}:00,{95 + i}" for d in days for i in range(2)])
        write(folder, "stress", [f"{d},{d},50,{'true' if s == 2 else 'false'}" for d in days])
    write(base / "notes", "steps", ["2024-01-01 10:00:00,1"])
    write(base / "7", "hrv", [])
    return str(base)


def metrics(spark, path):
    return {r.metric: r.value for r in spark.read.json(path).collect() if r.value is not None}


def test_data_stages(spark, root, tmp_path):
    out = str(tmp_path)
    stages.data_stages(spark, root, out)
    audit = {(r.student_id, r.modality): r for r in spark.read.parquet(f"{out}/audit/modality_audit").collect()}
    assert len(audit) == 8 * 7
    assert audit["8", "steps"].exists == 0 and audit["8", "steps"].rows == 0
    assert audit["7", "hrv"].exists == 1 and audit["7", "hrv"].rows == 0
    assert audit["1", "steps"].rows == 30 and audit["1", "steps"].unique_days == 10
    assert audit["1", "daily_questions"].rows == 14
    available = {r.student_id: r for r in spark.read.parquet(f"{out}/audit/availability").collect()}
    assert (available["8"].has_all_modalities, available["8"].complete_target_days) == (0, 0)
    assert (available["1"].has_all_modalities, available["1"].complete_target_days) == (1, 10)
    assert metrics(spark, f"{out}/audit/summary")["subjects_with_all_modalities"] == "7"
    built = metrics(spark, f"{out}/build/build_audit")
    assert built["rows"] == str(8 * 12 + 1) and built["surplus_rows"] == "1"
    panel = {(r.student_id, str(r.date)): r for r in spark.read.parquet(f"{out}/clean/panel").collect()}
    assert len(panel) == 8 * 12
    first = panel["1", "2024-01-01"]
    assert (first.stress, first.stress_label) == (12.5, "Low")
    assert (first.total_steps, first.sedentary_minutes, first.very_active_minutes) == (3.0, 1.0, 0.0)
    assert first.avg_oxygen == 95.5 and first.std_oxygen == pytest.approx(0.5**0.5)
    assert panel["2", "2024-01-03"].CALCULATION_FAILED is True
    assert panel["8", "2024-01-01"].total_steps is None and panel["7", "2024-01-01"].avg_rmssd is None
    splits = {r.split: r.subjects for r in spark.read.parquet(f"{out}/model/split_summary").collect()}
    assert splits == {"test": 2, "train": 6}
    sets = tables.read_column_sets(spark, f"{out}/model/column_sets")
    assert tables.column_set(sets, "feature_groups", "sleep_only") == ["sleep_score", "deep_sleep_minutes"]
    with pytest.raises(KeyError):
        tables.column_set(sets, "nowhere")
    assert spark.read.parquet(f"{out}/description/spearman").count() > 0


def test_sorted_tables_hold_ranges(spark, tmp_path):
    frame = spark.range(5000).selectExpr("CAST(id * 7919 % 5000 AS STRING) AS subject", "id % 13 AS day").repartition(6)
    tables.write_table(frame, f"{tmp_path}/t", order=["subject", "day"])
    read = spark.read.parquet(f"{tmp_path}/t").selectExpr("_metadata.file_name AS f", "subject")
    ranges = sorted(map(tuple, read.groupBy("f").agg({"subject": "min"}).collect()))
    ends = dict(map(tuple, read.groupBy("f").agg({"subject": "max"}).collect()))
    assert all(ends[a] <= low for (a, _), (_, low) in zip(ranges, ranges[1:])) and read.count() == 5000


def test_panel_csv_round_trip(spark, tmp_path):
    row = [("1", None, 3.0, "Low", None, *[None] * 12, None, True)]
    frame = spark.createDataFrame(row, tables.panel_schema(WEARABLE))
    tables.write_table(frame, f"{tmp_path}/p", fmt="csv")
    again = tables.read_panel_csv(spark, f"{tmp_path}/p", WEARABLE)
    assert again.schema == frame.schema and again.collect() == frame.collect()


def test_models_and_robustness(spark, root, tmp_path):
    out = str(tmp_path)
    stages.build(spark, root, f"{out}/build")
    stages.cleaning(spark, f"{out}/build", f"{out}/clean")
    stages.model_data(spark, f"{out}/clean", f"{out}/model")
    panel = spark.read.parquet(f"{out}/model/model_table")
    chosen = {
        "majority_baseline": families.FAMILIES["majority_baseline"],
        "random_forest": Family(families.FAMILIES["random_forest"].build, {"n_estimators": [3], "max_depth": [2, 3]}),
    }
    results = tuning.compare_feature_sets(panel, WEARABLE, {"sleep": ["sleep_score"]}, chosen, 2)
    found = {r.model: r for r in results.collect()}
    assert found["majority_baseline"].cv_macro_f1 is None and found["majority_baseline"].n_candidates == 1
    assert found["random_forest"].n_candidates == 2 and 0 <= found["random_forest"].cv_macro_f1 <= 1
    fixed = {"small": ("random_forest", {"n_estimators": 2, "max_depth": 2}, "sleep_only")}
    stages.robustness_checks(spark, f"{out}/model", f"{out}/checks", fixed=fixed, draws=30)
    summary = spark.read.parquet(f"{out}/checks/bootstrap_summary").first()
    assert summary.n_draws == 30 and summary.ci_lower_2_5 <= summary.mean_macro_f1 <= summary.ci_upper_97_5
    assert spark.read.parquet(f"{out}/checks/leave_one_out_summary").first().n_subjects == 6
    folds = spark.read.parquet(f"{out}/checks/leave_one_out_folds")
    assert folds.count() == 6 and set(folds.columns) == {"analysis", "student_id", "n_rows", "macro_f1"}
    # Without a grid: one fit per feature set; the search itself is tested above.
    small = {"n_estimators": 2, "max_depth": 2}
    quick = {
        "majority_baseline": families.FAMILIES["majority_baseline"],
        "random_forest": Family(lambda p, i, r: families.FAMILIES["random_forest"].build(small, i, r)),
    }
    stages.model_comparison(spark, f"{out}/model", f"{out}/compared", chosen=quick, folds=2)
    sizes = {"models": 1, "feature_groups": 4, "temporal": 5, "deviation": 2}
    for name, conditions in sizes.items():
        table = spark.read.parquet(f"{out}/compared/{name}_results")
        assert table.count() == 2 * conditions and {"lead", "hardest_label", "n_features"} <= set(table.columns)
        assert table.where("model = 'majority_baseline' AND lead <> 0").count() == 0
        assert spark.read.parquet(f"{out}/compared/{name}_best").count() == conditions
        assert spark.read.parquet(f"{out}/compared/{name}_best_overall").count() == 1
        matrix = spark.read.parquet(f"{out}/compared/{name}_confusion")
        assert matrix.count() == 6 * conditions
    settings = {"majority_baseline": {}, "random_forest": {"n_estimators": 2, "max_depth": 2}}
    stages.untuned_comparison(spark, f"{out}/model", f"{out}/plain", ["semester_week"], settings=settings)
    assert spark.read.parquet(f"{out}/plain/untuned_results").count() == 2
    with pytest.raises(ValueError, match="nulls"):
        stages.untuned_comparison(spark, f"{out}/model", f"{out}/x", ["avg_rmssd"])


def test_odd_files_are_read_by_name(spark, tmp_path):
    """Missing texts, an extra and a reordered column, mixed dates, absurd seconds."""
    write(tmp_path / "1", "steps", ["2024-01-01 10:00:00,NaN", "01/01/2024 11:00:00,5", "Jan 1 2024 10:00,NA", "20240102,7"])
    (tmp_path / "2").mkdir()
    (tmp_path / "2" / "steps.csv").write_text("note,steps,timestamp\nx,3,2024-01-01 10:00:00\ny,,1/2/2024\n")
    (tmp_path / "3").mkdir()
    (tmp_path / "3" / "steps.csv").write_text("timestamp\n2024-01-01\n")
    write(tmp_path / "1", "daily_questions", [f"0,0,{1704067200000},0,0,0,0,nan,3", "0,0,1704067200,0,0,0,0,5,NULL"])
    scan = files.scan_modality(spark, str(tmp_path), "steps")
    assert scan.columns == ["subject_id", "timestamp", "steps"]
    got = list((r.student_id, str(r.date), r.value) for r in src.file_readings(spark, str(tmp_path), WEARABLE).where(
        "modality = 'steps'").withColumnRenamed("steps__steps", "value").collect())
    one, two = "2024-01-01", "2024-01-02"
    assert sorted(map(str, got)) == sorted(map(str, [
        ("1", one, None), ("1", one, 5.0), ("1", one, None), ("1", two, 7.0), ("2", one, 3.0), ("2", two, None), ("3", one, None)]))
    rows = files.scan_modality(spark, str(tmp_path), "daily_questions").collect()
    assert sorted((str(r.stress), str(r.anxiety)) for r in rows) == [("5.0", "None"), ("None", "3.0")]
    days = [r[0] for r in files.scan_modality(spark, str(tmp_path), "daily_questions").select(src.file_day("daily_questions")).collect()]
    assert sorted(map(str, days)) == ["2024-01-01", "None"]
