"""Shards by vector bin packing.

Equal texts form a group with a vector of bytes, tokens and rows. Every group
goes to the shard whose residual capacity has the highest dot product with its
vector, all of them measured in shares of the whole corpus. Groups above
1/LARGE of the corpus in any dimension, at most 3 * LARGE, are placed one by
one. The others are alike within a cell of a grid over bytes, tokens and rows:
the dot product says how many groups of a cell each shard takes, and their
order by digest says which. The grid is bounded, so packing reads a bounded
table. A group larger than a shard is cut into pieces by doc_id first.

The law is ``bytes``: sizes come out near equal. Slots number a shard's
documents from 0 in a seeded order.

Edge cases: a null text has size 1 and goes with the empty text; a null doc_id
is kept. Rows repeated whole get slots of their own. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions.ordering import with_hash_ordinal
from panelloom.llm.common import cut_lineage, identified, read

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARDS = 8
LAW = "bytes"
LARGE = 2_048
SEED = 23
PER_OCTAVE = 64  # cells of bytes per doubling
SIZES = ["bytes", "tokens", "rows"]
# Weights of the dimensions in the dot product; the law is about bytes.
LEAD = np.array([1.0, 0.05, 0.0001])
CHUNKS = 128
MEASURED = "doc_id bigint, digest binary, text_crc32 bigint, bytes bigint, tokens bigint"


def _measure(batches):
    for batch in batches:
        texts = [t.as_py() for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                pa.array([zlib.crc32(t) for t in texts], pa.int64()),
                pa.array([len(t) + 1 for t in texts], pa.int64()),
                pa.array([len(t.split()) for t in texts], pa.int64()),
            ],
            ["doc_id", "digest", "text_crc32", "bytes", "tokens"],
        )


def _totals(groups: DataFrame) -> np.ndarray:
    row = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in SIZES]).first()
    return np.array([float(v) for v in row])


def pack(items: np.ndarray, counts: np.ndarray, total: np.ndarray, shards: int) -> np.ndarray:
    """How many of each item's ``counts`` alike groups every shard takes.

    Largest first by the weighted sum of shares. Groups that are alike are
    placed one by one, or in CHUNKS chunks where there are more.
    """
    weight = items / np.maximum(total, 1)
    residual = np.ones((shards, items.shape[1])) / shards
    taken = np.zeros((len(items), shards), np.int64)
    for i in np.argsort(-(weight @ LEAD), kind="stable"):
        left, chunk = int(counts[i]), -(-int(counts[i]) // CHUNKS)
        while left > 0:
            number = min(chunk, left)
            shard = int(np.argmax(residual @ (LEAD * weight[i])))
            residual[shard] -= number * weight[i]
            taken[i, shard] += number
            left -= number
    return taken


def _cells() -> list:
    """Place of a group in the grid: bytes finely, tokens per byte and rows by halving."""
    size = F.floor(F.log2("bytes") * PER_OCTAVE)
    words = F.greatest(F.lit(0), F.least(F.lit(40), F.floor(F.log2((F.col("bytes") + 1) / (F.col("tokens") + 1)) * 2)))
    return [size.cast("int").alias("c0"), words.cast("int").alias("c1"), F.floor(F.log2("rows")).cast("int").alias("c2")]


def place_groups(groups: DataFrame, total: np.ndarray, shards: int) -> tuple[DataFrame, DataFrame]:
    """(digest, piece, shard) of the large groups and of the others."""
    spark = groups.sparkSession
    large = " OR ".join(f"{c} * {LARGE}L > {int(t)}L" for c, t in zip(SIZES, total))
    big = groups.where(large).orderBy("digest", "piece").collect()  # at most 3 * LARGE rows
    small = groups.where(f"NOT ({large})").select("*", *_cells())
    cells = small.groupBy("c0", "c1", "c2").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in SIZES])
    cells = cells.orderBy("c0", "c1", "c2").collect()  # bounded by the grid
    vectors = [[float(r[c]) for c in SIZES] for r in big] + [[float(r[c]) / r["n"] for c in SIZES] for r in cells]
    counts = np.array([1] * len(big) + [r["n"] for r in cells], np.int64)
    taken = pack(np.array(vectors).reshape(-1, 3), counts, total, shards)
    placed = spark.createDataFrame(
        [(bytes(r["digest"]), r["piece"], int(taken[i].argmax())) for i, r in enumerate(big)], "digest binary, piece int, shard int"
    )
    plan = spark.createDataFrame(
        [(r["c0"], r["c1"], r["c2"], np.cumsum(taken[i]).tolist()) for i, r in enumerate(cells, len(big))],
        "c0 int, c1 int, c2 int, ends array<bigint>",
    )
    numbered = with_hash_ordinal(small, ["digest", "piece"], SEED, ["c0", "c1", "c2"])
    shard = F.size(F.filter("ends", lambda e: e <= F.col("ordinal")))
    spread = numbered.join(F.broadcast(plan), ["c0", "c1", "c2"]).select(
        "digest", "piece", shard.cast("int").alias("shard")
    )
    return placed, spread


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per document."""
    rows = cut_lineage(identified(docs).select("doc_id", "text").mapInArrow(_measure, MEASURED))
    sums = [F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    whole = rows.groupBy("digest").agg(*sums)
    total = _totals(whole)
    # A group above a shard's share in some dimension; fewer than 3 * shards.
    parts = F.greatest(*[F.ceil(F.col(c) * shards / F.lit(max(1.0, t))) for c, t in zip(SIZES, total)]).cast("int")
    cut = whole.select("digest", parts.alias("parts")).where("parts > 1")
    piece = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id"), F.col("parts"))).otherwise(0).cast("int")
    pieced = rows.join(F.broadcast(cut), "digest", "left").withColumn("piece", piece).drop("parts")
    groups = cut_lineage(pieced.groupBy("digest", "piece").agg(*sums))
    placed, spread = place_groups(groups, total, shards)
    near = pieced.join(F.broadcast(placed), ["digest", "piece"])
    far = pieced.join(F.broadcast(placed.select("digest", "piece")), ["digest", "piece"], "left_anti")
    sharded = cut_lineage(near.unionByName(far.join(spread, ["digest", "piece"])))
    return with_hash_ordinal(sharded, ["doc_id", "digest"], SEED, ["shard"], name="slot").select(
        "doc_id",
        F.col("bytes").alias("size"),
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )


def op5_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(read(spark, folder, "documents"))
