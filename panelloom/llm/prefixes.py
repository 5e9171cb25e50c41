"""Prefix trie of conversations, rolled up in bands of depth.

A node is a distinct beginning of a conversation. Its identity is a digest of
its turns, built by bands of BAND depths: turns within a band are hashed
together behind the digest of all earlier bands, which is found the same way one
level up. Totals of subtrees go the same road: a node adds itself to its
ancestors within its band only; the tops of the bands, with what their bands
hold, are a trie of their own, BAND times as shallow, which is rolled up first;
its completed totals then reach the ancestors in the band above. Rounds grow as
the logarithm of the depth and no row is copied to more than 2 * BAND others.

Positions in a conversation come from a range sort and the counts of its
pieces, so a conversation may hold any share of the rows. Texts are hashed
where they are read and never shuffled.

Edge cases: null roles and texts are empty. Turns sort by turn, nulls first,
then by the SHA-256 of role length, role and text; rows repeated whole are turns
of their own. Rows without a conv_id belong to no conversation and take no part,
since members are named by their conv_id. Negative ids take the remainder with
the sign of the id. An empty table has no node, not even the root. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.llm.common import attach, cut_lineage, read

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BAND = 16
# Conversations are named to the digest of a node's ends in pieces of so many.
PIECE = 4096
SHARED = 20  # conversations that borrow the beginning of one
WORD = r"[^\x20\x09-\x0D]+"
NOTHING = hashlib.sha256(b"").hexdigest()


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place, as (conv_id, piece, at, said, words) and (conv_id, piece, first, before, n).

    A turn's place, from 1, is ``before + at - first + 1``; a piece is what a
    range of the sort holds of one conversation.
    """
    said = F.sha2(F.concat(F.char_length(_text("role")).cast("string"), F.lit(":"), _text("role"), _text("text")), 256)
    turns = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        said.alias("said"),
        F.regexp_count(_text("text"), F.lit(WORD)).alias("words"),
        F.monotonically_increasing_id().alias("salt"),  # equal rows may fall into several ranges
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("said"), F.col("salt")]
    placed = cut_lineage(
        turns.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv_id", "said", "words", F.monotonically_increasing_id().alias("at"))
        .withColumn("piece", F.shiftright("at", 33))
    )
    pieces = placed.groupBy("conv_id", "piece").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return placed, cut_lineage(pieces.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, i, said, words, last): the root at i = 0 and the rebuilt turns behind it; last is the final i."""
    placed, pieces = numbered(rows)
    lengths = pieces.groupBy("conv_id").agg(F.sum("n").alias("n"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("bigint")
    convs = lengths.select("conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    borrowed = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = cut_lineage(
        convs.join(bases, "base", "left").select(
            "conv_id", "base", "h", borrowed.alias("taken"), (borrowed + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("last")
        )
    )
    own = placed.join(pieces.drop("n").join(convs, "conv_id"), ["conv_id", "piece"]).withColumn(
        "place", F.col("before") + F.col("at") - F.col("first") + 1
    )
    # No borrower takes more than three turns, and a base has at most 2 * SHARED borrowers.
    lent = own.where("place <= 3").select(F.col("conv_id").alias("base"), "place", "said", "words")
    heads = lent.join(convs, "base").where("place <= h").select("conv_id", F.col("place").alias("i"), "said", "words", "last")
    tails = own.where("place > h").select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("i"), "said", "words", "last")
    roots = convs.select("conv_id", F.lit(0).cast("bigint").alias("i"), F.lit(NOTHING).alias("said"), F.lit(0).alias("words"), "last")
    return roots.unionByName(heads).unionByName(tails)


def _deepest(bands: DataFrame) -> int:
    return bands.agg(F.max("k")).first()[0] or 0


def _band_of(name: str) -> Column:
    return F.expr(f"{name} DIV {BAND}")


def _gather(rows: DataFrame, fields: list[str], **also: Column) -> DataFrame:
    """One row per conversation and band, the fields as arrays in order of i; at most BAND items."""
    grouped = rows.groupBy("conv_id", _band_of("i").alias("k")).agg(
        F.sort_array(F.collect_list(F.struct("i", *fields))).alias("items"), *[c.alias(n) for n, c in also.items()]
    )
    return grouped.select("conv_id", "k", *also, *[F.col(f"items.{f}").alias(f) for f in fields])


def identify(bands: DataFrame) -> DataFrame:
    """Add ``ids``: for each item a digest of the whole sequence up to it."""
    before = F.lit("")
    if _deepest(bands) > 0:
        full = bands.where(F.size("said") == BAND)
        upper = _gather(full.select("conv_id", F.col("k").alias("i"), F.sha2(F.array_join("said", ""), 256).alias("said")), ["said"])
        known = identify(cut_lineage(upper)).select("conv_id", "k", F.posexplode("ids").alias("place", "before"))
        known = known.select("conv_id", (F.col("k") * BAND + F.col("place") + 1).alias("k"), "before")
        bands = bands.join(known, ["conv_id", "k"], "left")
        before = F.coalesce("before", F.lit(""))
    upto = F.transform(
        F.sequence(F.lit(1), F.size("said")),
        lambda n: F.sha2(F.concat(before, F.lit(":"), F.array_join(F.slice("said", 1, n), "")), 256),
    )
    return bands.withColumn("ids", upto).drop("before")


def rollup(nodes: DataFrame, bands: DataFrame) -> DataFrame:
    """(id, leaves, saved) summed over subtrees, for nodes (id, conv_id, depth, leaves, saved).

    ``conv_id`` is any conversation through the node, and bands (conv_id, k,
    ids) hold the ids along it.
    """
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    placed = nodes.withColumn("k", _band_of("depth")).join(bands.select("conv_id", "k", "ids"), ["conv_id", "k"])
    upwards = F.explode(F.slice("ids", F.lit(1), (F.col("depth") % BAND + 1).cast("int"))).alias("id")
    inner = cut_lineage(placed.select(upwards, "leaves", "saved").groupBy("id").agg(*sums))
    if _deepest(bands) == 0:
        return inner
    tops = nodes.where(F.col("depth") % BAND == 0).select("id", "conv_id", _band_of("depth").alias("depth"))
    upper = _gather(bands.select("conv_id", F.col("k").alias("i"), F.col("ids")[0].alias("ids")), ["ids"])
    whole = rollup(tops.join(inner, "id"), cut_lineage(upper))
    sent = tops.where("depth > 0").withColumn("k", F.col("depth") - 1).join(whole, "id")
    above = sent.join(bands.select("conv_id", "k", "ids"), ["conv_id", "k"]).select(F.explode("ids").alias("id"), "leaves", "saved")
    return cut_lineage(inner.unionByName(above).groupBy("id").agg(*sums))


def _hash_pieces(batches):
    """Running SHA-256 over the pieces of each id, which arrive in order."""
    schema = pa.schema([("id", pa.string()), ("ends_sha256", pa.string())])
    name, digest = None, None
    for batch in batches:
        out = []
        for i, piece in zip(batch.column("id").to_pylist(), batch.column("piece").to_pylist()):
            if i == name:
                digest.update(b",")
            else:
                if name is not None:
                    out.append((name, digest.hexdigest()))
                name, digest = i, hashlib.sha256()
            digest.update(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in (0, 1)], schema=schema)
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest.hexdigest()])], schema=schema)


def named_ends(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) of the conversations (id, conv_id) that end at each node.

    Ids are joined into pieces in parallel; only the pieces of a node meet, as
    a sorted stream through one digest.
    """
    placed = ends.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")
    pieces = (
        placed.withColumn("piece", F.expr(f"monotonically_increasing_id() DIV {PIECE}"))
        .groupBy("id", "piece")
        .agg(F.sort_array(F.collect_list("conv_id")).alias("members"))
        .select("id", F.col("members")[0].alias("first"), F.array_join(F.col("members").cast("array<string>"), ",").alias("piece"))
    )
    streamed = pieces.repartition("id").sortWithinPartitions("id", "first").select("id", "piece")
    return streamed.mapInArrow(_hash_pieces, "id string, ends_sha256 string")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """All nodes, as the query returns them, of conversations (conv_id, turn, role, text)."""
    banded = _gather(rebuilt(rows), ["said", "words"], last=F.max("last"))
    bands = cut_lineage(identify(cut_lineage(banded)).select("conv_id", "k", "ids", "words", "last"))
    passed = bands.select("conv_id", "k", "last", F.posexplode(F.arrays_zip("ids", "words")).alias("place", "item")).select(
        F.col("item.ids").alias("id"), "conv_id", (F.col("k") * BAND + F.col("place")).alias("depth"), F.col("item.words").alias("words"), "last"
    )
    nodes = cut_lineage(
        passed.groupBy("id").agg(
            F.min("conv_id").alias("conv_id"),
            F.min("depth").alias("depth"),
            F.count("*").alias("n_convs"),
            F.max("words").alias("words"),
            F.max(F.col("depth") < F.col("last")).alias("inner"),
        )
    )
    within, above = bands.select("conv_id", "k", "ids"), bands.select("conv_id", (F.col("k") + 1).alias("k"), F.get("ids", F.lit(BAND - 1)).alias("over"))
    place = (F.col("depth") % BAND).cast("int")
    linked = nodes.withColumn("k", _band_of("depth")).join(within, ["conv_id", "k"]).join(above, ["conv_id", "k"], "left")
    linked = cut_lineage(linked.withColumn("parent", F.when(place > 0, F.get("ids", place - 1)).otherwise(F.col("over"))).drop("ids", "over", "k"))
    children = linked.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"))
    counted = cut_lineage(linked.join(children.withColumnRenamed("parent", "id"), "id", "left").fillna(0, ["n_children"]))
    parents = counted.where("n_children > 0").select(
        F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings")
    )
    named = attach(counted.where("parent IS NOT NULL"), parents, "parent", "siblings").drop("siblings")
    named = named.unionByName(counted.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    saved = (F.col("n_convs") - 1) * F.col("words")
    totals = rollup(
        nodes.select("id", "conv_id", "depth", F.when(F.col("inner"), 0).otherwise(1).cast("bigint").alias("leaves"), saved.alias("saved")), bands
    )
    ends = bands.where(F.col("k") == _band_of("last")).select(F.get("ids", (F.col("last") % BAND).cast("int")).alias("id"), "conv_id")
    return (
        named.join(totals, "id")
        .join(named_ends(ends), "id", "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
        )
    )


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations."""
    return prefix_trie(read(spark, folder, "conversations"))


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, for engines without one; ``crc_table`` must be a CTE and in FROM."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    step = "xor(c >> 8, crc_table.v[CAST(xor(c, b) & 255 AS INTEGER) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {step}))"


CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY n) AS v FROM (
    SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256))))"""

ORACLE = f"""
WITH {CRC_TABLE},
t AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS place FROM t),
ids AS (SELECT DISTINCT conv_id FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM ids, crc_table),
whole AS (
  SELECT c.conv_id, 0 AS part, o.place, said, words FROM c JOIN o ON o.conv_id = c.base AND o.place <= c.h
  UNION ALL
  SELECT c.conv_id, 1, o.place, said, words FROM c JOIN o ON o.conv_id = c.conv_id AND o.place > c.h),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM whole),
chain AS (
  SELECT conv_id, depth, words, sha256(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS id FROM d
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS final FROM chain),
node AS (
  SELECT id, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, max(words) AS words, bool_and(final) AS leaf,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE final), '')) AS ends_sha256
  FROM ended GROUP BY id),
over AS (
  SELECT n.id, a.id AS above, a.depth FROM node n JOIN chain a ON a.conv_id = n.conv_id AND a.depth <= n.depth),
total AS (
  SELECT above AS id, count(*) FILTER (WHERE leaf) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens
  FROM over JOIN node USING (id) GROUP BY above),
up AS (SELECT n.id, a.above AS parent FROM node n JOIN over a ON a.id = n.id AND a.depth = n.depth - 1),
kids AS (SELECT parent AS id, count(*) AS n_children FROM up GROUP BY parent)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  saved_tokens, n.ends_sha256
FROM node n JOIN total USING (id) LEFT JOIN kids USING (id) LEFT JOIN up USING (id) LEFT JOIN node p ON p.id = up.parent
"""
