"""MinHash fingerprints of documents, their likeness, and near copies by bands.

Words are hashed by prefix sums of a polynomial over the bytes, five words in a
row make a shingle, and HASHES universal hash functions (odd multiplier and
offset modulo 2^64) take their minimum over a text's shingles, all in numpy. A
fingerprint holds 16 bits of each minimum; the share of equal places estimates
the Jaccard similarity of the shingle sets, with a standard error of 0.044 at
most. Documents are range-sorted by doc_id and streamed, so that each meets the
next one; only the last of a range waits for the first of the next range.

Near copies: fingerprints are cut into BANDS bands, and those that share a band
are candidates. Every fingerprint is first compared, on the whole shingle sets,
with the least member of the band that it shares most bands with; then members
of one band that these links leave in different components are compared with
one another. Equal fingerprints are one member, so copies are never paired, and
bands of near copies are not either: a link to one of them is enough.

Edge cases: null texts are empty; texts without a word have the fingerprint of
all ones, alike one another; fewer than five words are one shingle. Order is by
doc_id, nulls first, ties by xxhash64 of the text; rows repeated whole follow one
another. The document after the last is the first, for a single one itself.
Words are taken after lower-casing A-Z. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import attach, cut_lineage, identified, read
from panelloom.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, HASHES = 5, 128
BANDS, ROWS = 21, 6
NEAR = 0.8
# Candidates across components are read whole if their fingerprints agree in so
# many places: four standard errors below NEAR.
WORTH = int(HASHES * (NEAR - 4 * (NEAR * (1 - NEAR) / HASHES) ** 0.5))
STRIP = 512  # shingles hashed at once
TOGETHER = 2_000  # texts compared with one other in a task
SEED = 20_261

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64 (fixed values): spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Shingles and minima of texts; holds the powers that texts so far needed."""

    def __init__(self) -> None:
        random = np.random.default_rng(SEED)
        odd = random.integers(0, 1 << 63, 2 + WORDS + 2 * HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base, self.length = int(odd[0]), odd[1]
        self.places, self.times, self.plus = odd[2 : 2 + WORDS], odd[2 + WORDS :][:HASHES, None], odd[2 + WORDS + HASHES :][:, None]
        self.back = pow(self.base, -1, 1 << 64)
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if n > len(self.powers):
            size = 1 << n.bit_length()
            with np.errstate(over="ignore"):
                self.powers, self.inverse = (
                    np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
                    for b in (self.base, self.back)
                )

    def shingles(self, text: str) -> np.ndarray:
        """One hash per shingle, repeats included."""
        octets = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
        ink = np.concatenate([[False], ~_BLANK[octets], [False]])
        turns = np.flatnonzero(ink[1:] != ink[:-1])
        start, end = turns[::2], turns[1::2]
        if not len(start):
            return np.empty(0, np.uint64)
        self._reach(len(octets) + 1)
        sums = np.zeros(len(octets) + 1, np.uint64)
        np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * self.powers[: len(octets)], out=sums[1:])
        words = mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * self.length)
        if len(words) < WORDS:
            return mix(np.sum(words * self.places[: len(words)], keepdims=True) + self.length * np.array([len(words)], np.uint64))
        rows = len(words) - WORDS + 1
        total = words[:rows] * self.places[0]
        for k in range(1, WORDS):
            total += words[k : k + rows] * self.places[k]
        return mix(total)

    def fingerprint(self, shingles: np.ndarray) -> np.ndarray:
        if not len(shingles):
            return np.full(HASHES, 0xFFFF, np.uint16)
        least = np.full(HASHES, 0xFFFFFFFFFFFFFFFF, np.uint64)
        for at in range(0, len(shingles), STRIP):
            hashed = self.times * shingles[None, at : at + STRIP]
            hashed += self.plus
            np.minimum(least, hashed.min(axis=1), out=least)
        # The high bits of a minimum are mostly zero; mixed, any sixteen will do.
        return (mix(least) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of shingles, each sorted and without repeats; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


FIELDS = [
    ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()),
    ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
RESULT = pa.schema(FIELDS)
# What a range leaves open: its first and its last document, with their texts.
OPEN = pa.schema([*FIELDS, ("piece", pa.int64()), ("end", pa.string()), ("text", pa.string())])
TYPES = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary", pa.float64(): "double"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {TYPES[f.type]}" for f in schema)


def _packed(found: np.ndarray) -> bytes:
    return found.astype(">u2").tobytes()


def _finish(hasher: Hasher, doc: dict, text: str, own: np.ndarray, after: str, after_own: np.ndarray) -> dict:
    """The row of a document, now that the one behind it is known."""
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    found = own if edited == text else hasher.fingerprint(hasher.shingles(edited))
    return doc | {
        "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        "edited_fingerprint": _packed(found),
        "near_edited": likeness(own, found),
        "near_next": likeness(own, after_own),
    }


def _stream(batches):
    """Rows of a range in order; the first and the last leave with their texts."""
    hasher, piece, held = Hasher(), TaskContext.get().partitionId(), None
    for batch in batches:
        out = []
        for doc_id, key, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text")]):
            own = hasher.fingerprint(hasher.shingles(text))
            doc = {"doc_id": doc_id, "text_key": key, "n_chars": len(text), "fingerprint": _packed(own)}
            if held is None:
                out.append(doc | {"piece": piece, "end": "first", "text": text})
            else:
                out.append(_finish(hasher, *held, text, own))
            held = (doc, text, own)
        yield pa.RecordBatch.from_pylist(out, OPEN)
    if held is not None:
        yield pa.RecordBatch.from_pylist([held[0] | {"piece": piece, "end": "last", "text": held[1]}], OPEN)


def _close(batches):
    """The last documents of the ranges, each with the text and fingerprint of the one behind."""
    hasher = Hasher()
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            own, after = (np.frombuffer(row[c], ">u2").astype(np.uint16) for c in ("fingerprint", "after_fingerprint"))
            doc = {c: row[c] for c in ("doc_id", "text_key", "n_chars", "fingerprint")}
            out.append(_finish(hasher, doc, row["text"], own, row["after_text"], after))
        yield pa.RecordBatch.from_pylist(out, RESULT)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document with the columns of RESULT, fingerprints as binary."""
    order = [F.asc_nulls_first("doc_id"), "text_key", "salt"]
    rows = identified(docs).withColumn("salt", F.monotonically_increasing_id())  # equal rows may fall into several ranges
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text_key", "text")
    streamed = cut_lineage(ordered.mapInArrow(_stream, _ddl(OPEN)))
    firsts = streamed.where("end = 'first'")
    pieces = sorted(r[0] for r in firsts.select("piece").collect())  # one number a range
    ring = docs.sparkSession.createDataFrame(list(zip(pieces, pieces[1:] + pieces[:1])), "piece bigint, behind bigint")
    behind = firsts.select(F.col("piece").alias("behind"), F.col("text").alias("after_text"), F.col("fingerprint").alias("after_fingerprint"))
    waiting = streamed.where("end = 'last'").join(ring, "piece").join(behind, "behind")
    columns = ["doc_id", "text_key", "n_chars", "fingerprint", "text", "after_text", "after_fingerprint"]
    closed = waiting.select(*columns).mapInArrow(_close, _ddl(RESULT))
    return streamed.where("end IS NULL").select(*RESULT.names).unionByName(closed)


def _compare(batches):
    """(a, b) of the pairs at NEAR or above; texts come as b's, then those to compare with it."""
    hasher, own = Hasher(), np.empty(0, np.uint64)
    for batch in batches:
        out = []
        for a, b, text in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "text")]):
            shingles = np.unique(hasher.shingles(text))
            if a is None:
                own = shingles
            elif jaccard(own, shingles) >= NEAR:
                out.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) are near; the texts of a popular b's pairs are dealt to many tasks."""
    pairs = cut_lineage(pairs)
    shares = pairs.groupBy("b").agg((F.count("*") / F.lit(TOGETHER)).cast("bigint").alias("most"))
    left = pairs.join(shares, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("most") + 1).alias("share"))
    right = shares.select(F.lit(None).cast("bigint").alias("a"), "b", F.explode(F.sequence(F.lit(0).cast("bigint"), "most")).alias("share"))
    named = lambda side, by: side.join(texts.withColumnRenamed("node", by), by)
    both = named(left, "a").unionByName(named(right, "b"))
    ordered = both.repartition("b", "share").sortWithinPartitions("b", "share", F.asc_nulls_first("a"))
    return cut_lineage(ordered.select("a", "b", "text").mapInArrow(_compare, "a bigint, b bigint"))


def _worth(batches):
    """Pairs whose fingerprints agree well enough to read their texts."""
    for batch in batches:
        ours, theirs = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(-1, HASHES) for c in ("fa", "fb"))
        keep = pa.array((ours == theirs).sum(axis=1) >= WORTH, pa.bool_())
        yield batch.select(["a", "b"]).filter(keep)


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, near_id), one row per document; near_id is the smallest doc_id linked with it, itself included.

    Links are between documents that share a band and have a Jaccard similarity
    of NEAR or more. Of those in one band only so many are compared as it takes
    to know its components.
    """
    known = cut_lineage(fingerprints(docs).select("doc_id", "text_key", "fingerprint"))
    least = F.min(F.struct("doc_id", "text_key"))
    kinds = known.groupBy("fingerprint").agg(least.alias("first"), F.min("doc_id").alias("least"), F.count("*").alias("n"))
    kinds = cut_lineage(kinds.select("fingerprint", "first.*", "least", "n", F.monotonically_increasing_id().alias("node")))
    piece = F.expr(f"substring(fingerprint, 1 + {2 * ROWS} * band, {2 * ROWS})")
    bands = kinds.select("node", "fingerprint", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    bands = bands.select("node", F.xxhash64("band", piece).alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("members"), F.min("node").alias("pivot")).where("members > 1")
    member = cut_lineage(bands.join(shared, "band").select("band", "node", "pivot"))
    # Each member first meets the pivot that it shares most bands with.
    met = member.where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("bands"))
    first = met.groupBy("node").agg(F.max_by("pivot", F.struct("bands", -F.col("pivot"))).alias("b")).withColumnRenamed("node", "a")
    involved = kinds.join(member.select("node").distinct(), "node", "left_semi").select(
        "node", F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key")
    )
    rows = identified(docs)
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key"))
    texts = cut_lineage(rows.join(involved, same).select("node", "text").dropDuplicates(["node"]))
    links = verified(first, texts)
    placed = member.select("band", "node").join(components(links), "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    split = cut_lineage(placed.join(mixed.select("band"), "band"))
    ours, theirs = (split.select("band", F.col("node").alias(n), F.col("root").alias(f"root_{n}")) for n in "ab")
    across = ours.join(theirs, "band").where("root_a < root_b").select("a", "b").distinct()
    prints = [kinds.select(F.col("node").alias(n), F.col("fingerprint").alias(f"f{n}")) for n in "ab"]
    across = across.join(prints[0], "a").join(prints[1], "b").mapInArrow(_worth, "a bigint, b bigint")
    links = links.unionByName(verified(across, texts))
    rooted = kinds.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("least").alias("near_id"))
    kept = cut_lineage(rooted.join(named, "root").select("fingerprint", "near_id", "n"))
    return attach(known, kept, "fingerprint", "n").select("doc_id", "near_id")


def op13_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    found = fingerprints(read(spark, folder, "documents"))
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return found.select("doc_id", "n_chars", "edited_sha256", *hexed, "near_edited", "near_next")
