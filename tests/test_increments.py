"""Panels built step by step equal those built at once."""

import os

import pytest

from panelloom.operators import daily
from panelloom.plans import increments, stages
from panelloom.sources import files
from panelloom.sources import readings as src
from panelloom.spec import WEARABLE

HEADS = {m: ",".join(f.name for f in files.schema_of(m).fields) for m in files.MODALITIES}


def write(root, subject, modality, lines):
    folder = root / str(subject)
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"{modality}.csv"
    path.write_text("\n".join([HEADS[modality], *lines]) + "\n")
    return path


def subject(root, s, days):
    write(root, s, "daily_questions", [f"0,0,{1704067200 + 86400 * d + 3600},0,0,0,0,{(s * 7 + d * 11) % 60},{d}" for d in days])
    dates = [f"2024-01-{d + 1:02d}" for d in days]
    write(root, s, "sleep", [f"{d}T06:00:00Z,{70 + s},{s}" for d in dates])
    write(root, s, "steps", [f"{d} 10:00:00,{s}" for d in dates for _ in range(3)] + ["bad,5"])
    write(root, s, "activity_level", [f"{d} 10:00:00,{level}" for d in dates for level in ("SEDENTARY", "VERY_ACTIVE", "")])
    write(root, s, "oxygen", [f"{d} 10:0{i}:00,{95 + i * s}" for d in dates for i in range(3)])
    write(root, s, "stress", [f"{d},{d},50,{'true' if s == 2 else 'false'}" for d in dates])


def shown(frame):
    rows = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.collect()]
    return sorted(rows, key=str)


def at_once(spark, root):
    return shown(daily.clean_panel(src.file_readings(spark, str(root)), WEARABLE, src.FILE_MEASURES, *stages.TARGET))


def stepped(spark, root, store):
    counts = increments.update(spark, str(root), str(store))
    got = increments.panel(spark, str(store))
    assert got.columns == WEARABLE.columns and shown(got) == at_once(spark, root)
    return counts


def test_steps_equal_one_build(spark, tmp_path):
    root, store = tmp_path / "raw", tmp_path / "store"
    subject(root, 1, range(4))
    subject(root, 2, range(3))
    first = stepped(spark, root, store)
    assert first == {"step": 1, "listed": 12, "read": 12, "parsed": 12, "gone": 0}
    # Nothing new: no file is read, no step is made.
    assert stepped(spark, root, store) == {"step": 1, "listed": 12, "read": 0, "parsed": 0, "gone": 0}
    # A new subject, a longer file, one rewritten in another order, one without rows.
    subject(root, 3, range(2))
    write(root, 1, "steps", [f"2024-01-{d:02d} 10:00:00,9" for d in range(1, 7)])
    path = root / "2" / "sleep.csv"
    head, *lines = path.read_text().splitlines()
    path.write_text("\n".join([head, *lines[::-1]]) + "\n")
    os.utime(path, (2_000_000_000, 2_000_000_000))
    write(root, 2, "oxygen", [])
    second = stepped(spark, root, store)
    assert second == {"step": 2, "listed": 18, "read": 9, "parsed": 8, "gone": 0}
    touched = spark.read.parquet(f"{store}/panel/step=2").select(WEARABLE.subject, WEARABLE.day).collect()
    assert {r[0] for r in touched} == {"1", "2", "3"} and len(touched) == len(set(touched)) == 6 + 3 + 2
    # Answers that are gone take their days with them; a file of no bytes is not listed.
    (root / "2" / "daily_questions.csv").unlink()
    (root / "3" / "hrv.csv").write_text("")
    third = stepped(spark, root, store)
    assert third == {"step": 3, "listed": 17, "read": 0, "parsed": 0, "gone": 1}
    # A file that comes back counts again.
    subject(root, 2, range(5))
    assert stepped(spark, root, store)["step"] == 4


def test_a_step_cut_off_is_not_seen(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "raw", tmp_path / "store"
    subject(root, 1, range(3))
    before = stepped(spark, root, store)["step"]
    expected = shown(increments.panel(spark, str(store)))
    subject(root, 2, range(3))

    def fail(*_):
        raise RuntimeError("cut off")

    with monkeypatch.context() as patch:
        patch.setattr(increments, "merge_states", fail)
        with pytest.raises(RuntimeError):
            increments.update(spark, str(root), str(store))
    assert shown(increments.panel(spark, str(store))) == expected
    assert stepped(spark, root, store)["step"] == before + 1
