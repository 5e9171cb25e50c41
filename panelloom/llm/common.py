"""Pieces the operators share: reading, batches of bounded size, joins with hot keys."""

from __future__ import annotations

import sys
import types

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.session import cut_lineage, prepare

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20
# A group with more than this share of all rows is joined by broadcast, so a
# broadcast of such groups never has more than HOT_SHARE rows.
HOT_SHARE = 500


def ready(spark: SparkSession) -> SparkSession:
    """Core settings, and Arrow batches that stay small however long the texts are."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{table}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text; a missing one counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def text_key() -> Column:
    """Tells rows apart that share a doc_id but not a text."""
    return F.xxhash64(whole_text())


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text) and nothing else, so that other columns cannot clash."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), whole_text().alias("text"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text divides by five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, sizes: DataFrame | None = None) -> DataFrame:
    """Join per-group columns to rows; ``size`` is the column with a group's rows.

    ``sizes`` (key, size) may stand apart, so that wide groups need not be
    joined to their sizes.

    Rows of one group may be a third of all. Groups above 1/HOT_SHARE of the
    total are at most HOT_SHARE and reach their rows by broadcast; the others
    are joined by a shuffle in which no key is large. Both sides are read
    twice, so pass frames that are cheap to read.
    """
    counted = groups if sizes is None else sizes
    total = counted.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) * HOT_SHARE > total
    keys = F.broadcast(counted.where(large).select(key))
    hot = groups.where(large) if sizes is None else groups.join(keys, key, "left_semi")
    cold = groups.where(~large) if sizes is None else groups
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(keys, key, "left_anti").join(cold, key)
    return near.unionByName(far)


def keep_rows(docs: DataFrame, winners: DataFrame) -> DataFrame:
    """Rows of ``docs`` named by winners (doc_id, text_key, copies), one row each.

    Winners with more than one copy are rows repeated whole; one stays.
    """
    names = winners.select(
        F.col("doc_id").alias("_keep_id"), F.col("text_key").alias("_keep_key"), F.col("copies").alias("_copies")
    )
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_keep_id")) & (text_key() == F.col("_keep_key"))
    once = docs.join(names.where("_copies = 1"), same, "left_semi")
    repeated = docs.join(names.where("_copies > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated)


def worker_cache(name: str, make):
    """A value made once per Python worker, whatever number of tasks it runs."""
    home = sys.modules.setdefault("_panelloom_worker", types.ModuleType("_panelloom_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


__all__ = ["attach", "cut_lineage", "held_out", "identified", "keep_rows", "read", "ready", "text_key", "whole_text", "worker_cache"]
