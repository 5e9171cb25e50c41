"""Many models trained over one pass at a time.

Rows are packed into blocks of numbers once; rows that are alike in all of them are
one with a count. A pass hands every block to all
models of a fleet, adds what they found by key and finishes each key where its
sums meet; the driver sees a few numbers per key. A model leaves out the rows of
one group (a fold, a subject) or of none, so all folds of a cross-validation and
all candidates share their passes, and the number of Spark jobs depends on the
number of passes alone.

What a pass moves is, per task, one array per key, whatever the number of rows.
Where all of these are few numbers (DIRECT) the driver adds them, which saves a shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.session import cut_lineage

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 4096
TASKS_PER_CORE = 4
DIRECT = 1_000_000  # numbers of all tasks that a pass may bring to the driver
NOBODY = -1  # the group that a model of all rows leaves out
BLOCK = "x binary, y binary, g binary, n binary, codes binary, state binary"

Block = dict[str, np.ndarray]


@dataclass(frozen=True)
class Layout:
    """Names of the inputs, the number of classes, and what missing values become by left-out group."""

    features: tuple[str, ...]
    classes: int
    medians: dict[int, np.ndarray]

    def filled(self, x: np.ndarray, out: int) -> np.ndarray:
        return np.where(np.isnan(x), self.medians[out], x)


@dataclass(frozen=True)
class Blocks:
    """Packed rows, the number of tasks they are dealt to, and how many they are (alike ones once)."""

    frame: DataFrame
    tasks: int
    rows: int


def pack(rows: DataFrame, features: Sequence[str], label: str, group: str, at_once: float = 1) -> Blocks:
    """Blocks of (features, label code, group code, rows alike); rows without a label code must be gone.

    A task gets ``at_once`` blocks or more, for fleets whose models take little time a block; a part of
    one for those whose models take long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = np.column_stack([part.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))])
                y = part.column("_y").to_numpy(zero_copy_only=False).astype(np.int8)
                g = part.column("_g").to_numpy(zero_copy_only=False).astype(np.int32)
                n = part.column("_n").to_numpy(zero_copy_only=False).astype(np.int64)
                yield as_batch({"x": x, "y": y, "g": g, "n": n})

    numbers = [F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]
    spread = rows.select(*numbers, F.col(label).cast("int").alias("_y"), F.col(group).cast("int").alias("_g"))
    return _dealt(spread.groupBy(*spread.columns).agg(F.count("*").alias("_n")), run, at_once)


def _dealt(counted: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], at_once: float) -> Blocks:
    """Counted rows as ``run`` packs them, over as many tasks as there are blocks, at most."""
    most = TASKS_PER_CORE * counted.sparkSession.sparkContext.defaultParallelism
    counted = counted.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # A pass costs a fixed time per task, so a task gets whole blocks.
        rows = counted.count()
        tasks = max(1, min(most, -(-rows // max(1, int(BLOCK_ROWS * at_once)))))
        return Blocks(cut_lineage(counted.repartition(tasks).mapInArrow(run, BLOCK)), tasks, rows)
    finally:
        counted.unpersist()


def as_batch(block: Block) -> pa.RecordBatch:
    """A block as it is kept; parts it lacks are empty."""
    return pa.RecordBatch.from_pydict({c: [block[c].tobytes() if c in block else b""] for c in ("x", "y", "g", "n", "codes", "state")})


def coded(blocks: Blocks, width: int, codes: Callable[[np.ndarray], np.ndarray], at_once: int = 1) -> Blocks:
    """Blocks of a byte per feature instead of its value; rows that then are alike become one."""

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = unpack(batch, i, width)
                whole = np.ascontiguousarray(np.column_stack([codes(block["x"]), block["y"].view(np.uint8)[:, None], block["g"].view(np.uint8).reshape(-1, 4)]))
                yield pa.RecordBatch.from_pydict({"_row": pa.array([r.tobytes() for r in whole], pa.binary()), "_n": pa.array(block["n"])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                whole = np.frombuffer(b"".join(part.column("_row").to_pylist()), np.uint8).reshape(-1, width + 5)
                n = part.column("_n").to_numpy(zero_copy_only=False)
                y, g = whole[:, width].view(np.int8), np.ascontiguousarray(whole[:, width + 1 :]).view(np.int32)
                yield as_batch({"codes": whole[:, :width].T, "y": y, "g": g, "n": n})

    counted = blocks.frame.mapInArrow(narrow, "_row binary, _n bigint").groupBy("_row").agg(F.sum("_n").alias("_n"))
    return _dealt(counted, run, at_once)


def joined(table: pa.Table, width: int) -> Block:
    """The coded blocks of a table as one."""
    blocks = [unpack(batch, i, width) for batch in table.to_batches() for i in range(batch.num_rows)]
    return {name: np.concatenate([b[name] for b in blocks], axis=-1) for name in ("y", "g", "n", "codes", "state")}


def unpack(batch: pa.RecordBatch, i: int, width: int) -> Block:
    out = {name: np.frombuffer(batch.column(name)[i].as_py(), kind) for name, kind in (("y", np.int8), ("g", np.int32))}
    out["x"] = np.frombuffer(batch.column("x")[i].as_py(), float).reshape(-1, width)
    out["n"] = np.frombuffer(batch.column("n")[i].as_py(), np.int64)
    out["codes"] = np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(width, -1)  # a feature's codes follow each other
    out["state"] = np.frombuffer(batch.column("state")[i].as_py(), np.float32)
    return out


def each_block(blocks: Blocks, width: int, change: Callable[[Block], Block]) -> Blocks:
    """Blocks as ``change`` leaves them, lineage cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield as_batch(change(unpack(batch, i, width)))

    return Blocks(cut_lineage(blocks.frame.mapInArrow(run, BLOCK)), blocks.tasks, blocks.rows)


def reduce(
    blocks: Blocks,
    width: int,
    partial: Callable[[Block], Iterator[tuple[int, np.ndarray]]],
    finish: Callable[[int, np.ndarray], list[float]] | None = None,
    numbers: int | None = None,
) -> dict[int, np.ndarray]:
    """Sums of the arrays that ``partial`` yields by key, each finished where it is summed.

    ``numbers`` is how many numbers the arrays of all keys have, if known.
    """

    def add(totals: dict[int, np.ndarray], key: int, value: np.ndarray) -> None:
        if key in totals:
            totals[key] += value
        else:
            totals[key] = np.array(value, float)

    alone = blocks.tasks == 1  # what one task summed is whole

    def emit(totals: dict[int, np.ndarray], whole: bool) -> pa.RecordBatch:
        keys = sorted(totals)
        if whole and finish is not None:
            totals = {k: np.array(finish(k, v), float) for k, v in totals.items()}
        return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int32()), "value": pa.array([totals[k].tobytes() for k in keys], pa.binary())})

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                for key, value in partial(unpack(batch, i, width)):
                    add(totals, key, value.ravel())
        yield emit(totals, alone)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, value in zip(batch.column("key").to_pylist(), batch.column("value")):
                add(totals, key, np.frombuffer(value.as_py()))
        yield emit(totals, True)

    sums = blocks.frame.mapInArrow(within, "key int, value binary")
    if not alone and numbers is not None and numbers * blocks.tasks <= DIRECT:
        totals: dict[int, np.ndarray] = {}
        for r in sums.collect():
            add(totals, r.key, np.frombuffer(r.value))
        return {k: v if finish is None else np.array(finish(k, v), float) for k, v in totals.items()}
    if not alone:
        sums = sums.repartition("key").mapInArrow(across, "key int, value binary")
    return {r.key: np.frombuffer(r.value) for r in sums.collect()}  # one row per key


def count_confusion(y: np.ndarray, predicted: np.ndarray, classes: int, n: np.ndarray | None = None) -> np.ndarray:
    """Rows by label and prediction; ``n`` are rows alike."""
    return np.bincount(y.astype(int) * classes + predicted, n, minlength=classes * classes).reshape(classes, classes)


def macro_f1(confusion: np.ndarray) -> float:
    """Over labels that occur on either side; labels never hit count zero."""
    hit, actual, said = np.diag(confusion), confusion.sum(axis=1), confusion.sum(axis=0)
    known = actual + said > 0
    return float(np.mean(2 * hit[known] / (actual + said)[known])) if known.any() else 0.0


def class_counts(blocks: Blocks, width: int, classes: int) -> dict[int, np.ndarray]:
    """Rows by class, per group; all of them under NOBODY."""

    def partial(block: Block):
        yield NOBODY, np.bincount(block["y"], block["n"], minlength=classes)
        for g in np.unique(block["g"]):
            own = block["g"] == g
            yield int(g), np.bincount(block["y"][own], block["n"][own], minlength=classes)

    return reduce(blocks, width, partial)
