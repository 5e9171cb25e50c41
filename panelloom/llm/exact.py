"""Exact dedup against a minimal perfect hash of the digests seen before.

Texts are equal when they are identical after lower-casing A-Z. The digests of
a history are spread over buckets by their leading bytes; each bucket gets a
minimal perfect hash whose slots hold the whole digest, the winner's doc_id and
the number of rows. New digests, counted once each, go to the slot the hash
names and are compared byte by byte: members take over the slot's group,
nonmembers form groups of their own.

Edge cases: a null text is the empty text. A null doc_id is smaller than any
other (it is carried as the smallest long). Rows repeated whole share a group,
and exactly one of them is kept. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import attach, cut_lineage, identified, keep_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Digests per bucket, of the history or of the new ones: a bucket row is about 0.4 MB.
BUCKET_KEYS = 8_192
NO_ID = -(2**63)
INDEX = "bucket int, sizes array<int>, levels array<binary>, digests binary, winners binary, rows binary"
GROUPS = "digest binary, keep_id bigint, group_size bigint"


def _digests(batches):
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        digest = [hashlib.sha256(t.as_py().lower()).digest() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(digest, pa.binary())],
            ["doc_id", "text_key", "digest"],
        )


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, digest): SHA-256 of the text with A-Z lower-cased."""
    return identified(docs).mapInArrow(_digests, "doc_id bigint, text_key bigint, digest binary")


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Position of each digest in a level's bit field."""
    mixed = words[:, level % 4] * np.uint64(2 * level + 0x9E3779B97F4A7C15) + words[:, (level + 1) % 4]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return (mixed % np.uint64(size)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit fields of the levels, and the slot of each of the distinct digests.

    A digest alone at its position takes a bit of the level; those that collide
    try the next level, with a field twice their number. The slot is the rank of
    the bit, so n digests have the slots 0 to n - 1.
    """
    words = keys.view("<u8")
    left, slots, levels, used = np.arange(len(keys)), np.zeros(len(keys), np.int64), [], 0
    while len(left):
        size = max(64, 2 * len(left))
        place = _place(words[left], len(levels), size)
        bits = np.bincount(place, minlength=size) == 1
        alone = bits[place]
        slots[left[alone]] = used + np.cumsum(bits)[place[alone]] - 1
        used += int(bits.sum())
        levels.append(bits)
        left = left[~alone]
        if len(levels) > 200:
            raise ValueError("the digests are not distinct")
    return levels, slots


def find_slots(levels: list[np.ndarray], stored: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Slot of each digest, or -1 where the slot's digest differs."""
    words = keys.view("<u8")
    found, left, used = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, bits in enumerate(levels):
        place = _place(words[left], level, len(bits))
        hit = bits[place]
        found[left[hit]] = used + np.cumsum(bits)[place[hit]] - 1
        used += int(bits.sum())
        left = left[~hit]
    some = found >= 0
    same = np.zeros(len(keys), bool)
    same[some] = (stored[found[some]] == keys[some]).all(axis=1)
    return np.where(same, found, -1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _index_bucket(key, table):
    keys = _matrix(table["digest"])
    levels, slots = perfect_hash(keys)
    order = np.argsort(slots)
    column = lambda name: table[name].to_numpy()[order].astype("<i8").tobytes()
    return pa.table(
        {
            "bucket": pa.array([key[0].as_py()], pa.int32()),
            "sizes": pa.array([[len(b) for b in levels]], pa.list_(pa.int32())),
            "levels": pa.array([[np.packbits(b).tobytes() for b in levels]], pa.list_(pa.binary())),
            "digests": pa.array([keys[order].tobytes()], pa.binary()),
            "winners": pa.array([column("keep_id")], pa.binary()),
            "rows": pa.array([column("group_size")], pa.binary()),
        }
    )


def _merge_bucket(key, index, new):
    """Groups of the history, grown by the members among the new, and the new ones."""
    keys = _matrix(new["digest"])
    winners, rows = new["keep_id"].to_numpy().astype(np.int64), new["group_size"].to_numpy().astype(np.int64)
    if not index.num_rows:
        return pa.table({"digest": new["digest"], "keep_id": winners, "group_size": rows})
    row = index.to_pylist()[0]
    levels = [np.unpackbits(np.frombuffer(b, np.uint8))[:n].astype(bool) for n, b in zip(row["sizes"], row["levels"])]
    stored = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
    kept, size = np.frombuffer(row["winners"], "<i8").copy(), np.frombuffer(row["rows"], "<i8").copy()
    slot = find_slots(levels, stored, keys)
    member = slot >= 0
    np.maximum.at(kept, slot[member], winners[member])
    np.add.at(size, slot[member], rows[member])
    digest = [d.tobytes() for d in stored] + [d.tobytes() for d in keys[~member]]
    return pa.table(
        {
            "digest": pa.array(digest, pa.binary()),
            "keep_id": np.concatenate([kept, winners[~member]]),
            "group_size": np.concatenate([size, rows[~member]]),
        }
    )


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size), counted before the shuffle."""
    return rows.groupBy("digest").agg(
        F.coalesce(F.max("doc_id"), F.lit(NO_ID)).alias("keep_id"), F.count("*").alias("group_size")
    )


def _bucket(buckets: int):
    return (F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint") % buckets).cast("int").alias("bucket")


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket with the perfect hash of its digests and the slots."""
    return history.select(_bucket(buckets), "*").groupBy("bucket").applyInArrow(_index_bucket, INDEX)


def merge_groups(index: DataFrame, new: DataFrame, buckets: int) -> DataFrame:
    """All groups after new ones (digest, keep_id, group_size) have been looked up."""
    left = index.groupBy("bucket")
    right = new.select(_bucket(buckets), "*").groupBy("bucket")
    return left.cogroup(right).applyInArrow(_merge_bucket, GROUPS)


def exact_groups(rows: DataFrame, historical) -> DataFrame:
    """Groups of all rows (doc_id, digest); ``historical`` says which rows came before."""
    old = cut_lineage(grouped(rows.where(historical)))
    new = cut_lineage(grouped(rows.where(~historical)))
    buckets = max(1, math.ceil(max(old.count(), new.count()) / BUCKET_KEYS))
    return merge_groups(build_index(old, buckets), new, buckets)


def seen_before(share: float = 0.5):
    """Stand-in for a history: a fixed half of the documents, chosen by their id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 1000 < int(share * 1000), F.lit(False))


def _no_id(column: str):
    return F.when(F.col(column) != NO_ID, F.col(column))


def exact_dedup(docs: DataFrame, historical=None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document."""
    rows = cut_lineage(digests(docs))
    groups = cut_lineage(exact_groups(rows, seen_before() if historical is None else historical))
    counted = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("_m"))
    joined = attach(cut_lineage(counted), groups, "digest", "group_size")
    return joined.select("*", F.explode(F.sequence(F.lit(1), F.col("_m"))).alias("_copy")).select(
        "doc_id",
        _no_id("keep_id").alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(_no_id("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from panelloom.llm.common import read

    return exact_dedup(read(spark, folder, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, with all its columns."""
    from panelloom.llm.common import ready

    ready(spark)
    rows = cut_lineage(digests(docs))
    groups = exact_groups(rows, seen_before())
    winning = F.coalesce("doc_id", F.lit(NO_ID)) == F.col("keep_id")
    # Rows of a group that carry the winner's id: one, unless ids repeat.
    named = rows.join(groups.select(F.col("digest").alias("_digest"), "keep_id"), (F.col("digest") == F.col("_digest")) & winning)
    counted = named.groupBy("digest", "doc_id", "text_key").agg(F.count("*").alias("copies"))
    winners = counted.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key", "copies")).alias("w")).select("w.*")
    return keep_rows(docs, winners)


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
      FROM documents)
WINDOW same AS (PARTITION BY body)
"""
