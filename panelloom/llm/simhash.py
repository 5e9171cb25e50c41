"""SimHash near-dedup with BK-trees.

A text's fingerprint is the bitwise majority of its shingles' XXH64. Two
fingerprints within RADIUS bits agree in at least two of six blocks, so every
link is found among the fingerprints that share a pair of blocks: such a set is
a shard. Each tile of a shard becomes a BK-tree whose children are keyed by
their integer distance to the parent; a query follows only edges within the
radius of its own distance. A task returns a spanning forest of the links it
found, never all pairs.

Trees are not broadcast to the whole cluster, because their number grows with
the input: a shard's trees go to that shard's queries, at most TILE of each.

Four bits of 64 find copies that differ in a few words. The pipeline's stage
reaches further: its fingerprints have WIDE bits over the distinct five-word
shingles, and two of them are near if at least NEAR of their bits agree. So many
differing bits leave no block alike, hence the shards of the stage are bands of
minima of universal hashes over the same shingles (documents with 0.8 of their
shingles in common share a band but for one in 10,000, with 0.65 but for one in
50). Of texts with the same wide fingerprint one text's bands count for all.

Edge cases: null texts are empty; texts without a word have fingerprint zero,
linked like any other. A null doc_id is ignored as a component's smallest
unless all its documents lack one (component_id is null then). Repeated rows
keep their number. An empty table gives an empty result.
"""

from __future__ import annotations

import sys
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import attach, cut_lineage, identified, keep_rows, read, ready
from panelloom.llm.components import components
from panelloom.llm.fingerprints import Hasher, mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 4
SEED = 42
RADIUS = 4
# Six blocks of 11 and 10 bits; a pair of them is the key of a shard.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
PAIRS = list(combinations(range(6), 2))
# Fingerprints of one tree. A larger shard is cut into tiles, and each pair of
# tiles is a task of its own.
TILE = 1_024
# The stage's fingerprints: bits, the share of them that near ones have alike, and
# the bands of minima that make its shards.
WIDE = 256
NEAR = 0.8
WIDE_RADIUS = int(WIDE * (1 - NEAR))
BANDS, ROWS = 20, 4
STRIP = 255  # shingles looked at together; their ones fit into a byte


def fingerprint(text: bytes, hasher) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    if len(words) < SHINGLE:
        hashes = np.array([hasher(joined, SEED)], np.uint64)
    else:
        starts, ends = (end - length)[: 1 - SHINGLE].tolist(), end[SHINGLE - 1 :].tolist()
        hashes = np.fromiter((hasher(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):  # bounded memory for very long texts
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    from xxhash import xxh64_intdigest

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        prints = np.array([fingerprint(t.as_py(), xxh64_intdigest) for t in texts], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(prints.view(np.int64))],
            ["doc_id", "text_key", "print"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, print), the fingerprint as a signed long."""
    return identified(docs).mapInArrow(_fingerprints, "doc_id bigint, text_key bigint, print bigint")


class WideHasher:
    """Wide fingerprint and bands of a text."""

    def __init__(self) -> None:
        self.hasher = Hasher()
        self.times, self.plus = self.hasher.times[: BANDS * ROWS], self.hasher.plus[: BANDS * ROWS]
        self.salts = mix(np.arange(1, WIDE // 64 + 1, dtype=np.uint64))
        self.places = mix(np.arange(1, ROWS + 1, dtype=np.uint64) << np.uint64(32)) | np.uint64(1)
        self.numbers = mix(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(16))

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        shingles = np.unique(self.hasher.shingles(text))
        if not len(shingles):
            return bytes(WIDE // 8), np.empty(0, np.int64)
        ones = np.zeros(WIDE, np.int64)
        least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
        for at in range(0, len(shingles), STRIP):
            part = shingles[at : at + STRIP]
            words = mix(part[:, None] + self.salts[None, :])
            ones += np.add.reduce(np.unpackbits(words.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
            np.minimum(least, (self.times * part[None, :] + self.plus).min(axis=1), out=least)
        bands = mix((mix(least).reshape(BANDS, ROWS) * self.places).sum(axis=1, dtype=np.uint64) + self.numbers)
        return np.packbits(2 * ones > len(shingles), bitorder="little").tobytes(), bands.view(np.int64)


def _wide(batches):
    hasher = WideHasher()
    for batch in batches:
        found = [hasher(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array([f for f, _ in found], pa.binary()),
             pa.array([b.tolist() for _, b in found], pa.list_(pa.int64()))],
            ["doc_id", "text_key", "print", "bands"],
        )


def wide_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, print, bands), the fingerprint as bytes."""
    return identified(docs).mapInArrow(_wide, "doc_id bigint, text_key bigint, print binary, bands array<bigint>")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one word each, or of rows of several words."""
    bits = np.bitwise_count(a ^ b).astype(np.int64)
    return bits.sum(axis=-1) if bits.ndim > 1 else bits


def build_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent and edge of every point of a BK-tree whose root is the first point.

    All points descend at once: of those that meet at a child's place, the first
    becomes the child and the others go on from there.
    """
    parent, edge = np.full(len(points), -1), np.zeros(len(points), np.int64)
    falling, at = np.arange(1, len(points)), np.zeros(max(0, len(points) - 1), np.int64)
    while len(falling):
        apart = distance(points[falling], points[at])
        _, first, place = np.unique(at * (WIDE + 1) + apart, return_index=True, return_inverse=True)
        child = falling[first]
        parent[child], edge[child] = at[first], apart[first]
        rest = np.ones(len(falling), bool)
        rest[first] = False
        at, falling = child[place][rest], falling[rest]
    return parent, edge


def search_tree(points: np.ndarray, parent: np.ndarray, edge: np.ndarray, queries: np.ndarray, radius: int):
    """Pairs (query, point) within the radius, all queries walking down together."""
    order = np.argsort(parent, kind="stable")
    begin = np.searchsorted(parent[order], np.arange(len(points)), "left")
    count = np.searchsorted(parent[order], np.arange(len(points)), "right") - begin
    asked, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
    found_q, found_p = [], []
    while len(asked):
        apart = distance(queries[asked], points[node])
        hit = apart <= radius
        found_q.append(asked[hit])
        found_p.append(node[hit])
        number = count[node]
        again = np.repeat(np.arange(len(asked)), number)
        offset = np.arange(len(again)) - np.repeat(np.cumsum(number) - number, number)
        child = order[begin[node][again] + offset]
        near = np.abs(edge[child] - apart[again]) <= radius
        asked, node = asked[again[near]], child[near]
    return np.concatenate(found_q), np.concatenate(found_p)


def forest(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``size`` points over the links."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        lower = label.copy()
        np.minimum.at(lower, left, low)
        np.minimum.at(lower, right, low)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def shard_links(tree: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints of a tree and its queries: a spanning forest."""
    everything = np.concatenate([tree, queries])
    if len(everything) == 2:
        near = distance(everything[:1], everything[1:])[0] <= radius
        return (everything[:1], everything[1:]) if near else (tree[:0], tree[:0])
    parent, edge = build_tree(tree)
    # The tile's own links are found where it meets itself.
    asked, point = search_tree(tree, parent, edge, queries if len(queries) else tree, radius)
    root = forest(len(everything), asked + (len(tree) if len(queries) else 0), point)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return everything[moved], everything[root[moved]]


def _links(batches):
    for batch in batches:
        left, right = [], []
        for tree, queries in zip(batch.column("tree").to_pylist(), batch.column("queries").to_pylist()):
            a, b = shard_links(np.array(tree, np.int64).view(np.uint64), np.array(queries, np.int64).view(np.uint64))
            left.append(a)
            right.append(b)
        if left:
            a, b = (np.concatenate(x).astype(np.uint64).view(np.int64) for x in (left, right))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _points(prints) -> np.ndarray:
    return np.frombuffer(b"".join(prints), np.uint64).reshape(-1, WIDE // 64)


def _near_hub(batches):
    for batch in batches:
        apart = distance(*(_points(batch.column(name).to_pylist()) for name in ("print", "hub")))
        near = batch.filter(pa.array(apart <= WIDE_RADIUS))
        yield pa.RecordBatch.from_arrays([near.column("print"), near.column("hub")], ["a", "b"])


def _wide_links(batches):
    for batch in batches:
        for tree, queries in zip(batch.column("tree").to_pylist(), batch.column("queries").to_pylist()):
            found = shard_links(_points(tree), _points(queries), WIDE_RADIUS)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in side], pa.binary()) for side in found], ["a", "b"])


def _block(number: int):
    start, width = BLOCKS[number]
    return F.shiftrightunsigned("print", start).bitwiseAND(F.lit((1 << width) - 1))


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within RADIUS; prints are distinct."""
    keys = [_block(i) * 2048 + _block(j) + F.lit(t << 22) for t, (i, j) in enumerate(PAIRS)]
    keyed = prints.select("print", F.explode(F.array(*keys)).alias("shard"))
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE)
    members = keyed.join(sizes, "shard").select(
        "shard", "print", tiles.alias("meets"), F.pmod(F.xxhash64("print"), tiles).alias("tile")
    )
    return _meetings(members).mapInArrow(_links, "a bigint, b bigint").distinct()


def wide_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of near wide fingerprints that share a band.

    nodes are (print, bands), a print once. Every print is first compared with
    the least one of each of its shards, its hub. What this connects is not
    compared again: of a shard with several components, the members outside the
    first one meet one another and those of the first. So a shard of many copies
    of one text costs its members once, not their pairs.
    """
    keyed = nodes.select("print", F.explode("bands").alias("shard"))
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n"), F.min("print").alias("hub")).where("n > 1")
    members = cut_lineage(attach(keyed, cut_lineage(sizes), "shard", "n"))
    hubs = members.where("print <> hub").select("print", "hub").distinct()
    stars = cut_lineage(hubs.mapInArrow(_near_hub, "a binary, b binary"))
    roots = components(stars).select(F.col("node").alias("print"), "root")
    labelled = members.join(roots, "print", "left").select("shard", "print", F.coalesce("root", "print").alias("label"))
    labelled = cut_lineage(labelled)
    counted = labelled.groupBy("shard", "label").agg(F.count("*").alias("c"))
    shards = counted.groupBy("shard").agg(
        F.min(F.struct("label", "c")).alias("first"), F.max("label").alias("last"), F.sum("c").alias("n")
    )
    parted = cut_lineage(
        shards.where("first.label <> last").select("shard", "n", F.col("first.label").alias("first"), F.col("first.c").alias("c"))
    )
    inner, outer = F.ceil(F.col("c") / TILE), F.ceil((F.col("n") - F.col("c")) / TILE)
    dealt = F.xxhash64("print")
    # Tiles of the first component are numbered after the others and meet those only.
    split = attach(labelled, parted, "shard", "n").select(
        "shard",
        "print",
        F.when(F.col("label") == F.col("first"), outer).otherwise(outer + inner).alias("meets"),
        F.when(F.col("label") == F.col("first"), outer + F.pmod(dealt, inner)).otherwise(F.pmod(dealt, outer)).alias("tile"),
    )
    return stars.unionByName(_meetings(split).mapInArrow(_wide_links, "a binary, b binary")).distinct()


def _meetings(members: DataFrame) -> DataFrame:
    """(tree, queries) of every pair of tiles that meet; members are (shard, print, tile, meets).

    A tile meets those numbered below ``meets``, itself among them or not, each once.
    """
    met = members.select("shard", "print", "tile", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)).alias("other"))
    groups = (
        met.groupBy("shard", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
        .agg(
            F.collect_list(F.when(F.col("tile") <= F.col("other"), F.col("print"))).alias("tree"),
            F.collect_list(F.when(F.col("tile") > F.col("other"), F.col("print"))).alias("queries"),
        )
        .where(F.size("tree") + F.size("queries") > 1)
        .where(F.size("tree") > 0)
    )
    return groups.select("tree", "queries")


def _components_of(rows: DataFrame, wide: bool = False) -> DataFrame:
    """(print, root, component_id, members): rows are (doc_id, print), members counts rows of a print.

    The root names a component; component_id may be null or shared by several.
    """
    bands = [F.min("bands").alias("bands")] if wide else []
    nodes = cut_lineage(rows.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("members"), *bands))
    found = wide_links(nodes.select("print", "bands")) if wide else links(nodes.select("print"))
    roots = components(found).withColumnRenamed("node", "print")
    rooted = cut_lineage(nodes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints"))
    return cut_lineage(attach(rooted, lowest, "root", "prints").select("print", "root", "component_id", "members"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document."""
    rows = cut_lineage(fingerprints(docs).select("doc_id", "print"))
    return attach(rows, _components_of(rows), "print", "members").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op1_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near wide fingerprints stays: the one with the smallest doc_id."""
    ready(spark)
    rows = cut_lineage(wide_fingerprints(docs))
    found = _components_of(rows, wide=True)
    # Only rows that carry their component's id can stay; those are few per component.
    named = rows.join(
        found.select(F.col("print").alias("_print"), "root", "component_id"),
        (F.col("print") == F.col("_print")) & F.col("doc_id").eqNullSafe(F.col("component_id")),
    )
    counted = named.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("copies"))
    winners = counted.groupBy("root").agg(F.min(F.struct("doc_id", "text_key", "copies")).alias("w"))
    return keep_rows(docs, winners.select("w.*"))
