"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes cuts texts where their content says so, hence a
passage that several documents share is cut alike in all of them. Chunk hashes
are counted over the corpus. A text none of whose chunks occurs elsewhere is
encoded where it is read. For the others, every distinct chunk is encoded once
and its tokens are joined back. A chunk's own tokens may differ from those that
its text gets inside a document, so the joins are repaired: tokens between two
places where the tokenizer always splits (a blank after a character that is not
white space) are encoded again as one piece, once, if chunks meet among them. A
text without such places is encoded once more as a whole.

Which chunks are shared is told to the readers by a bit field of fixed size. A
false positive only sends a text the other way; the results do not depend on it.

Edge cases: a null text is empty and has no tokens. Texts that hold an added
token's string are encoded whole where they are read. Equal texts are encoded
once; rows repeated whole keep their number. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import json
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import attach, cut_lineage, identified, read, ready, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "byte_bpe_50k.json"
WINDOW = 16  # bytes that decide about a cut
CUT_BITS = 10  # a cut every 2 ** CUT_BITS bytes on average
LEAST, MOST = 256, 8_192  # bytes of a chunk
FILTER_BITS = 26  # the bit field has 2 ** FILTER_BITS bits, 8 MB
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Encoder of a vocabulary file, and bytes and decimal text of each id."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            described = json.load(file)
        # Byte-level vocabularies write bytes as printable characters.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.added = {t["content"]: t["id"] for t in described["added_tokens"]}
        ranks = {
            bytes(byte_of[c] for c in token): i
            for token, i in described["model"]["vocab"].items()
            if token not in self.added
        }
        core = tiktoken.Encoding(
            name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.plain = core.encode_ordinary
        size = max([*ranks.values(), *self.added.values()]) + 1
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.bytes_of = [b""] * size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.opens = np.array([b[:1] in (b" ", b"\n", b"\t", b"\r") for b in self.bytes_of])
        self.closes = np.array([_ends_solid(b) for b in self.bytes_of])

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; strings of added tokens get their ids."""
        for content, i in self.added.items():
            if content in text:
                ids: list[int] = []
                for at, part in enumerate(text.split(content)):
                    ids += [i] * (at > 0) + self.encode(part)
                return ids
        return self.plain(text)

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def joined(self, parts) -> list[int]:
        """Ids of the joined texts from the ids of each, which are arrays or lists.

        What lies between two places where the tokenizer always splits is encoded
        again once if parts meet in it, however many they are.
        """
        done: list[int] = []
        run: list[list[int]] = []  # ids since the last such place, by part
        for part in parts:
            ids = np.asarray(part, np.int64)
            if not len(ids):
                continue
            places = np.flatnonzero(self.opens[ids[1:]] & self.closes[ids[:-1]]) + 1
            if not len(places):
                run.append(ids.tolist())
                continue
            first, last = int(places[0]), int(places[-1])
            run.append(ids[:first].tolist())
            done += self._repaired(run)
            done += ids[first:last].tolist()
            run = [ids[last:].tolist()]
        return done + self._repaired(run)

    def _repaired(self, run: list[list[int]]) -> list[int]:
        if len(run) < 2:
            return run[0] if run else []
        return self.plain(b"".join([self.decode(ids) for ids in run]).decode())

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two joined texts."""
        return self.joined([left, right])


def _ends_solid(token: bytes) -> bool:
    """Whether a token ends with a whole character that is not white space."""
    try:
        return not token.decode()[-1:].isspace() and len(token) > 0
    except UnicodeDecodeError:
        return False


def codec(name: str = VOCABULARY) -> Codec:
    return worker_cache("codec_" + name, lambda: Codec(name))


def chunks(data: bytes) -> list[bytes]:
    """Cut UTF-8 text by content; the pieces joined are the text.

    The rolling hash of the WINDOW bytes before a place is a difference of
    prefix sums; a place is a cut where its top bits are zero. Cuts closer than
    LEAST are passed over and pieces longer than MOST are cut at MOST, always
    before a character's first byte.
    """
    n = len(data)
    if n <= LEAST:
        return [data] if n else []
    b = np.frombuffer(data, np.uint8)
    place = np.flatnonzero(_rolling(b) >> np.uint64(64 - CUT_BITS) == 0) + WINDOW
    place = place[place < n]
    place = place[(b[place] & 0xC0) != 0x80].tolist()
    out, begin = [], 0
    for cut in [*place, n]:
        while cut - begin > MOST:
            end = begin + MOST
            while b[end] & 0xC0 == 0x80:
                end -= 1
            out.append(data[begin:end])
            begin = end
        if cut - begin >= LEAST or cut == n:
            out.append(data[begin:cut])
            begin = cut
    return [c for c in out if c]


def _rolling(b: np.ndarray) -> np.ndarray:
    """Hash of every WINDOW bytes, by doubling the window four times."""
    h = (b.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    step = 1
    while step < WINDOW:
        factor = np.uint64(pow(int(_MULTIPLIER), step, 1 << 64))
        h = h[:-step] * factor + h[step:] if len(h) > step else h[:0]
        step *= 2
    return h * np.uint64(0xD6E8FEB86659FD93)


def _chunk_hash(chunk: bytes) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(chunk)


def _whole(text: bytes, added: list[bytes]) -> bool:
    return any(a in text for a in added)


def _outline(name: str):
    def run(batches):
        added = [a.encode() for a in codec(name).added]
        for batch in batches:
            digest, hashes = [], []
            for t in batch.column("text").cast(pa.binary()):
                text = t.as_py()
                digest.append(hashlib.sha256(text).digest())
                hashes.append([] if _whole(text, added) else [_chunk_hash(c) for c in chunks(text)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(digest, pa.binary()), pa.array(hashes, pa.list_(pa.binary()))],
                ["doc_id", "digest", "hashes"],
            )

    return run


def _filter(shared: DataFrame) -> np.ndarray:
    """Bit field of the shared chunks; at most 2 ** (FILTER_BITS - 5) words come to the driver."""
    leading = F.conv(F.hex(F.substring("hash", 1, 4)), 16, 10).cast("bigint")
    words = (
        shared.select(F.shiftright(leading, 32 - FILTER_BITS).alias("number"))
        .groupBy(F.shiftright("number", 5).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(number & 31 AS int)))").alias("bits"))
        .toArrow()
    )
    field = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    field[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return field


def _known(field: np.ndarray, hashed: bytes) -> bool:
    number = int.from_bytes(hashed[:4], "big") >> (32 - FILTER_BITS)
    return bool(int(field[number >> 5]) >> (number & 31) & 1)


def _finish(tool: Codec, ids: list[int]) -> tuple[int, str, str]:
    text = ",".join([tool.decimal[i] for i in ids])
    decoded = tool.decode(ids).decode("utf-8", "replace").encode()
    return len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _unshared(name: str, field):
    """Results of the texts that share no chunk."""

    def run(batches):
        tool = codec(name)
        added = [a.encode() for a in tool.added]
        bits = field.value
        for batch in batches:
            ids, out = [], []
            for doc_id, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                text = t.as_py()
                if _whole(text, added) or not any(_known(bits, _chunk_hash(c)) for c in chunks(text)):
                    ids.append(doc_id)
                    out.append(_finish(tool, tool.encode(text.decode())))
            yield _batch([ids, *(zip(*out) if out else ((), (), ()))], RESULT)

    return run


_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(columns, schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), _TYPES[kind]) for c, (_, kind) in zip(columns, fields)], [n for n, _ in fields]
    )


def _chunk_rows(name: str, field):
    """Chunks of the texts that share one, each once per batch."""

    def run(batches):
        added = [a.encode() for a in codec(name).added]
        bits = field.value
        for batch in batches:
            found: dict[bytes, bytes] = {}
            for t in batch.column("text").cast(pa.binary()):
                text = t.as_py()
                if not _whole(text, added):
                    pieces = {_chunk_hash(c): c for c in chunks(text)}
                    if any(_known(bits, h) for h in pieces):
                        found |= pieces
            yield _batch([list(found), list(found.values())], "hash binary, chunk binary")

    return run


def _encode_chunks(name: str):
    def run(batches):
        tool = codec(name)
        for batch in batches:
            ids = [np.array(tool.plain(c.as_py().decode()), tool.kind).tobytes() for c in batch.column("chunk")]
            yield _batch([batch.column("hash").to_pylist(), ids], "hash binary, ids binary")

    return run


def _assemble(name: str):
    def run(batches):
        tool = codec(name)
        for batch in batches:
            out = []
            for pieces in batch.column("pieces").to_pylist():
                out.append(_finish(tool, tool.joined(np.frombuffer(piece["ids"], tool.kind) for piece in pieces)))
            yield _batch(
                [batch.column("digest").to_pylist(), *(zip(*out) if out else ((), (), ()))],
                "digest binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
            )

    return run


def _routed(field):
    """Outlines of the texts that share a chunk, by the same test as in ``_unshared``."""

    def run(batches):
        bits = field.value
        for batch in batches:
            keep = [any(_known(bits, h) for h in hashes) for hashes in batch.column("hashes").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


OUTLINE = "doc_id bigint, digest binary, hashes array<binary>"


def encode_documents(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per document."""
    texts = identified(docs).select("doc_id", "text")
    outline = cut_lineage(texts.mapInArrow(_outline(name), OUTLINE))
    # Copies of a text share all of its chunks.
    counted = outline.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))
    field = docs.sparkSession.sparkContext.broadcast(_filter(counted.where("n > 1").select("hash")))
    alone = texts.mapInArrow(_unshared(name, field), RESULT)

    routed = outline.mapInArrow(_routed(field), OUTLINE)
    distinct = cut_lineage(routed.groupBy("digest").agg(F.first("hashes").alias("hashes"), F.count("*").alias("copies")))
    refs = distinct.select("digest", F.posexplode("hashes").alias("at", "hash"))
    once = (
        texts.select("text")
        .mapInArrow(_chunk_rows(name, field), "hash binary, chunk binary")
        .groupBy("hash")
        .agg(F.first("chunk").alias("chunk"))
        .mapInArrow(_encode_chunks(name), "hash binary, ids binary")
    )
    encoded = cut_lineage(once)
    uses = cut_lineage(refs.groupBy("hash").agg(F.count("*").alias("uses")))
    pieces = F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("pieces")
    done = (
        attach(refs, encoded, "hash", "uses", uses)
        .groupBy("digest")
        .agg(pieces)
        .mapInArrow(_assemble(name), "digest binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    )
    done = cut_lineage(done.join(distinct.select("digest", "copies"), "digest"))
    shared = attach(routed.select("doc_id", "digest"), done, "digest", "copies").drop("digest", "copies")
    return alone.unionByName(shared)


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(read(spark, folder, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    ready(spark)
    return encode_documents(docs)
