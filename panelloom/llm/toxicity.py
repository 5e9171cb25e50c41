"""Toxicity through a noisy channel.

Obfuscated words are restored before they are scored. A character lattice holds
the readings of each written symbol: a letter reads as itself, leetspeak as the
letters it stands for, a run of one letter as one or two of it, and blanks or
marks between single letters as nothing. Viterbi decoding picks the reading
that a character trigram model, counted over all documents, and the channel
together find most likely. Restored words are looked up among features, whole
words and word beginnings, that a bounded sample of labelled rows has shown to
mark toxic texts; the score is the chance that at least one of the features
found makes the text toxic, by its share of toxic texts in the sample.

Letters under accents may stand for the bare ones. A restored word matches a
feature that differs in the length of runs if the lattice admits that reading.
Only what holds the skeleton of a feature (blanks and marks dropped, look-alikes
merged, runs collapsed) can be restored to it, so only that is decoded: words,
parts of words between marks, and pieces apart by any blanks, each out to the
next sign that is no letter or digit. Signs that may stand for a letter are
taken as letters throughout a written word, or dropped throughout it.

Edge cases: null and empty texts hold no feature and get the lowest score.
Documents with several label rows count as toxic if one says so; null labels
are not learnt from. Without labels no feature is known and all scores are
below one half. Rows repeated whole keep their number.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import cut_lineage, held_out, identified, read, ready, whole_text, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Labelled rows that the features and weights are learnt from, at most.
MAX_LABELLED = 20_000
# A feature needs so many toxic texts and, among the texts that hold it, this
# share of toxic ones; z compares its two rates.
LEAST_DOCS, LEAST_PRECISION, LEAST_Z = 5, 0.9, 2.8
PREFIXES = (4, 5, 6)
REJECT = 0.5

# Letters that digits and signs stand for in leetspeak.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c",
}
MARKS = ".,;:-_*'\"`~^/\\#%&=?<>[]{})"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
SIDE = 64  # symbols of the trigram model: a boundary, the letters, others
CHANNEL = {"leet": -1.0, "lost": -12.0, "run": -0.7, "gap": -0.7, "accent": -1.5}


def _symbols() -> np.ndarray:
    """Number of each code point up to U+00FF: 0 boundary, 1.. letters, 63 others."""
    table = np.full(0x101, SIDE - 1, np.int64)
    table[[9, 10, 11, 12, 13, 32]] = 0
    for i, c in enumerate(LETTERS):
        table[ord(c)] = i + 1
    return table


def _trigrams(batches):
    """Trigram counts of a task's texts; at most SIDE ** 3 rows."""
    table, total = _symbols(), np.zeros(SIDE**3, np.int64)
    for batch in batches:
        for t in batch.column("text"):
            text = t.as_py().lower()
            for at in range(0, len(text), 1 << 20):  # bounded memory; two symbols overlap
                codes = np.frombuffer(f" {text}  "[at : at + (1 << 20) + 2].encode("utf-32-le"), "<u4")
                s = table[np.minimum(codes, 0x100)]
                total += np.bincount((s[:-2] * SIDE + s[1:-1]) * SIDE + s[2:], minlength=SIDE**3)
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities of a symbol after two others, counted over all documents."""
    counted = (
        docs.select(whole_text().alias("text"))
        .mapInArrow(_trigrams, "cell bigint, n bigint")
        .groupBy("cell")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # at most SIDE ** 3 rows
    )
    three = np.zeros(SIDE**3)
    three[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    three = three.reshape(SIDE, SIDE, SIDE)
    two = three.sum(axis=0)
    one = two.sum(axis=0) + 1.0
    p1 = one / one.sum()
    p2 = (two + 5 * p1[None, :]) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None, :, :]) / (three.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def _bare(c: str) -> str:
    """The letter under an accent, or the sign itself."""
    first = unicodedata.normalize("NFD", c)[:1]
    return first if first.isascii() and first.isalpha() else c


def lattice(written: str) -> list[list[tuple[str, float]]]:
    """Readings (letters, log-probability) of each run of one symbol."""
    out = []
    for run in re.finditer(r"(.)\1*", written, re.S):
        c, n = run[1], len(run[0])
        times = [(m, 0.0 if m == n else CHANNEL["run"]) for m in ((1, 2) if n > 1 else (1,))]
        if c in LEET:
            readings = [(x * m, CHANNEL["leet"] + p) for x in LEET[c] for m, p in times]
            readings += [("", CHANNEL["lost"])] * (not c.isdigit())
        elif c.isspace():
            readings = [(" ", 0.0), ("", CHANNEL["gap"])]
        elif c.isalpha():
            readings = [(c * m, p) for m, p in times]
            if (bare := _bare(c)) != c:
                readings += [(bare * m, CHANNEL["accent"] + p) for m, p in times]
        else:
            readings = [("", 0.0)]
        out.append(readings)
    return out


def decode(written: str, model: np.ndarray) -> str:
    """Most likely reading by Viterbi; the state is the last two symbols."""
    table = _symbols()
    states = {(0, 0): (0.0, "")}
    for readings in [*lattice(written), [(" ", 0.0)]]:
        ahead: dict = {}
        for (a, b), (value, text) in states.items():
            for letters, channel in readings:
                x, y, score = a, b, value + channel
                for c in letters:
                    z = int(table[min(ord(c), 0x100)])
                    score += float(model[x, y, z])
                    x, y = y, z
                if (x, y) not in ahead or score > ahead[x, y][0]:
                    ahead[x, y] = (score, text + letters)
        states = ahead
    return max(states.values())[1].rstrip(" ")


def once(word: str) -> str:
    """A word with runs of one letter collapsed."""
    return re.sub(r"(.)\1+", r"\1", word)


def admits(written: str, feature: str) -> bool:
    """Whether the lattice holds a reading that is the feature, or begins with it for a beginning."""
    start = feature.endswith("~")
    letters = feature.removesuffix("~")
    reached = {0}
    for readings in lattice(written):
        ahead = set()
        for at in reached:
            for said, _ in readings:
                said = said.strip(" ")
                if letters.startswith(said, at):
                    ahead.add(at + len(said))
                elif start and said.startswith(letters[at:]):
                    return True
        reached = ahead
        if start and len(letters) in reached:
            return True
    return len(letters) in reached


def _alike() -> bytes:
    """Translation that merges look-alikes: digits and signs, and the letters they stand for."""
    same = {"i": "1!|l", "o": "0", "z": "2", "e": "3", "a": "4@", "s": "5$", "t": "7+", "b": "869g", "c": "("}
    table = bytearray(range(256))
    for to, many in same.items():
        for c in many:
            table[ord(c)] = ord(to)
    for c in "\t\n\r\x0b\x0c":
        table[ord(c)] = 32
    return bytes(table)


_DROPPED = MARKS.encode()
_END_MARKS = re.compile(rb"[!$+|(@]+(?=[\s" + re.escape(_DROPPED) + rb"]|$)")
_RUN = re.compile(rb"([^ ])\1+")
_GAPS = re.compile(r"(?<!\S)\S(?:\s+\S){2,}[^\w\s]*(?!\S)")
_NEXT = re.compile(r"[\W_]+[^\W_]+")
SIGNS = "@$!|+("


def _classes(signs: bool) -> np.ndarray:
    """Class of each code point up to U+FFFF: 0 dropped, a letter's code, 1 other letters."""
    alike, out = _alike(), np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        if c.isalnum():
            bare = ord(_bare(c.lower()))
            out[code] = alike[bare] if bare < 0x80 else code if code < 0x100 else 1
    if signs:
        out[[ord(c) for c in SIGNS]] = [alike[ord(c)] for c in SIGNS]
    return out


def _squeeze(text: str, classes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The skeleton of a whole text, the places kept, and the first of them in each run."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    mapped = classes[np.minimum(codes, 0xFFFF)]
    kept = np.flatnonzero(mapped)
    mapped = mapped[kept]
    first = np.flatnonzero(np.concatenate([[True], mapped[1:] != mapped[:-1]])) if len(kept) else kept
    return mapped[first].tobytes(), kept, first


def _any_of(shapes: set[bytes]) -> re.Pattern | None:
    """Finds every place where one of the shapes begins; they share a tree of beginnings."""
    if not shapes:
        return None

    def tree(some: list[bytes]) -> bytes:
        if b"" in some:
            return b""
        heads: dict[bytes, list[bytes]] = {}
        for s in some:
            heads.setdefault(s[:1], []).append(s[1:])
        parts = [re.escape(h) + tree(rest) for h, rest in sorted(heads.items())]
        return parts[0] if len(parts) == 1 else b"(?:" + b"|".join(parts) + b")"

    return re.compile(b"(?=" + tree(sorted(shapes)) + b")")


def skeleton(lower: bytes, table: bytes) -> bytes:
    """Lower-case text with marks dropped, look-alikes merged and runs collapsed."""
    return _RUN.sub(rb"\1", lower.translate(table, _DROPPED))


def plain_words(text: str) -> set[str]:
    """Lower-cased words without the marks around them."""
    edges = MARKS + "!$+|(@"
    return {w.strip(edges) for w in set(text.lower().split())} - {""}


def _beginnings(word: str) -> list[str]:
    return [word] + [word[:n] + "~" for n in PREFIXES if len(word) > n]


def _training_features(batches):
    """Distinct features of each labelled text."""
    for batch in batches:
        found = []
        for t in batch.column("text"):
            words = plain_words(t.as_py())
            found.append(sorted({f for w in words for f in _beginnings(w)}))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("toxic"), pa.array(found, pa.list_(pa.string()))],
            ["row", "toxic", "features"],
        )


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents outside the held-out fold."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(column).alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return identified(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text_key", "text", "label")


def learn(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    """Log of the chance that each chosen feature, seen alone, leaves a text clean.

    The empty name stands for texts without any feature.
    """
    rows = labelled(docs, labels, "toxic", MAX_LABELLED).select(
        F.xxhash64("doc_id", "text_key").alias("row"), (F.col("label") > 0).cast("int").alias("toxic"), "text"
    )
    found = rows.mapInArrow(_training_features, "row bigint, toxic int, features array<string>")
    # Near copies would lend each other's rare words the weight of many texts.
    sketch = F.slice(F.sort_array(F.transform("features", lambda f: F.xxhash64(f))), 1, 4)
    found = cut_lineage(found.withColumn("sketch", sketch).dropDuplicates(["sketch", "toxic"]).drop("sketch"))
    total = found.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    toxic, clean = float(total[1]), float(total[0] - total[1])
    a, b = F.col("a"), F.col("n") - F.col("a")
    ratio = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))
    z = ratio / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    counted = (
        found.select("toxic", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
        .where((a >= LEAST_DOCS) & (a >= LEAST_PRECISION * F.col("n")) & (z >= LEAST_Z))
        .orderBy("feature")
    )
    # Every one occurs in LEAST_DOCS texts of the bounded sample at least.
    chosen = most_specific({r["feature"]: (r["a"], r["n"]) for r in counted.collect()})
    known = F.array(*map(F.lit, chosen)).cast("array<string>")
    rest = found.where(~F.arrays_overlap("features", known))
    leak = rest.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    weights = {f: math.log1p(-a / (n + 0.5)) for f, (a, n) in chosen.items()}
    return {"": math.log1p(-min(0.4, (leak[0] + 0.1) / (leak[1] + 1)))} | weights


def most_specific(chosen: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
    """Drop beginnings whose toxic texts nearly all hold one chosen longer feature."""

    def covered(f: str) -> bool:
        return f.endswith("~") and any(
            g != f and g.startswith(f[:-1]) and a >= 0.9 * chosen[f][0] for g, (a, _) in chosen.items()
        )

    return {f: v for f, v in chosen.items() if not covered(f)}


class Scorer:
    """Finds the features of a text, restored where it is obfuscated, and weighs them."""

    def __init__(self, weights: dict[str, float], model: np.ndarray) -> None:
        self.weights, self.model, self.table, self.decoded = weights, model, _alike(), {}
        words = [f for f in weights if f and not f.endswith("~")]
        starts = [f[:-1] for f in weights if f.endswith("~")]
        self.words = {self._shape(w.encode()) for w in words} - {b""}
        self.starts = {self._shape(s.encode()) for s in starts} - {b""}
        self.lengths = sorted({len(s) for s in self.starts})
        self.parts = sorted(self.words | self.starts)
        self.classes = [worker_cache(f"classes_{signs}", lambda signs=signs: _classes(signs)) for signs in (True, False)]
        self.wide_words = {self._wide(w) for w in words} - {b""}
        self.wide_starts = {self._wide(s) for s in starts} - {b""}
        wide = self.wide_words | self.wide_starts
        self.spread, self.spans, self.known = _any_of(wide), sorted({len(s) for s in wide}), wide
        self.within: dict[str, set[str]] = {}
        self.by_once: dict[str, list[str]] = {}
        for f in weights:
            self.by_once.setdefault(once(f), []).append(f)

    def _named(self, written: str) -> set[str]:
        """Features that a piece is or begins with, as written and as restored.

        The model may prefer one letter where two were meant: restored words and
        features are compared with runs collapsed, and what then agrees must be
        a reading of the piece.
        """
        found = {f for w in (written, *self._restored(written)) for f in _beginnings(w) if f in self.weights}
        for word in self._restored(written):
            bare = once(word)
            for f in self.by_once.get(bare, []):
                if f and f not in found and admits(written, f):
                    found.add(f)
            for n in range(1, len(bare) + 1):
                for f in self.by_once.get(bare[:n] + "~", []):
                    if f not in found and len(word) >= len(f) and admits(written, f):
                        found.add(f)
        return found

    def _restored(self, written: str) -> list[str]:
        if written not in self.decoded:
            if len(self.decoded) > 50_000:
                self.decoded.clear()
            self.decoded[written] = decode(written, self.model).split()
        return self.decoded[written]

    def _shape(self, lower: bytes) -> bytes:
        return skeleton(lower, self.table)

    def _suspect(self, lower: bytes) -> bool:
        shape = self._shape(lower)
        return shape in self.words or any(shape[:n] in self.starts for n in self.lengths)

    def _wide(self, text: str, variant: int = 0) -> bytes:
        return _squeeze(text, self.classes[variant])[0]

    def _written(self, lower: str, variant: int) -> set[str]:
        """Places that hold a feature's skeleton, each out to the next sign that is no letter or digit."""
        shape, kept, first = _squeeze(lower, self.classes[variant])
        out = set()
        for at in (m.start() for m in self.spread.finditer(shape)):
            for length in self.spans:
                part = shape[at : at + length]
                if len(part) < length or part not in self.known:
                    continue
                # Of the outer runs only what is next to the others: neighbours may have joined them.
                begin = int(kept[first[at + 1] - 1] if length > 1 else kept[first[at]])
                end = int(kept[first[at + length - 1]]) + 1
                while begin and lower[begin - 1] == lower[begin]:
                    begin -= 1
                while end < len(lower) and lower[end] == lower[end - 1]:
                    end += 1
                while begin and lower[begin - 1].isalnum():
                    begin -= 1
                whole = end
                while end < len(lower) and lower[end].isalnum():
                    end += 1
                out.add(lower[begin:end])
                if end == whole and part in self.wide_starts:  # a beginning alone: the rest may stand apart
                    rest = _NEXT.match(lower, end)
                    if rest:
                        out.add(lower[begin:end] + rest[0])
        return out

    def _features_in(self, written: str, variant: int) -> set[str]:
        """Features that a piece of text is or begins with, as written and as restored."""
        shape = self._wide(written, variant)
        if shape not in self.wide_words and not any(shape[:n] in self.wide_starts for n in self.spans):
            return set()
        if written not in self.within:
            if len(self.within) > 50_000:
                self.within.clear()
            self.within[written] = self._named(written)
        return self.within[written]

    def found(self, data: bytes) -> set[str]:
        features: set[str] = set()
        lower = data.lower()
        shapes = set(self._shape(lower).split())
        cut = _END_MARKS.sub(b"", lower)
        if len(cut) < len(lower):
            shapes.update(self._shape(cut).split())
        hit = shapes & self.words or any(
            not self.starts.isdisjoint({s[:n] for s in shapes}) for n in self.lengths
        )
        text = None
        if hit:
            text = data.decode("utf-8", "replace")
            for written in set(text.lower().split()):
                raw = written.encode()
                cut = _END_MARKS.sub(b"", raw)
                if self._suspect(raw) or self._suspect(cut):
                    for core in {cut.decode("utf-8", "replace").strip(MARKS), written.strip(MARKS)}:
                        features |= self._named(core)
        text = text if text is not None else data.decode("utf-8", "replace")
        if self.spread is not None:
            small = text.lower()
            for variant in (0, 1) if any(c in small for c in SIGNS) else (0,):
                for written in self._written(small, variant):
                    features |= self._features_in(written, variant)
        for run in _GAPS.findall(text):
            run = run.rstrip(MARKS + "!$+|(@ ")
            shape = _RUN.sub(rb"\1", b"".join(self._shape(run.lower().encode()).split()))
            if any(p in shape for p in self.parts):
                features |= self._named(run.lower())
        return features

    def score(self, data: bytes) -> float:
        """Chance that at least one feature makes the text toxic, each by itself (noisy or).

        Of a word and its beginnings only the strongest counts.
        """
        strongest: dict[str, float] = {}
        for f in self.found(data):
            stem = f[: PREFIXES[0]]
            strongest[stem] = min(strongest.get(stem, 0.0), self.weights[f])
        return -math.expm1(self.weights[""] + sum(sorted(strongest.values())))


def _score(weights, shared):
    def run(batches):
        scorer = Scorer(weights, shared.value)
        for batch in batches:
            score = [scorer.score(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def _clean(weights, shared):
    def run(batches):
        scorer = Scorer(weights, shared.value)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            keep = [not t.is_valid or scorer.score(t.as_py()) < REJECT for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document."""
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    shared = spark.sparkContext.broadcast(language_model(docs))
    scored = identified(docs).select("doc_id", "text").mapInArrow(_score(learn(docs, labels), shared), "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not rejected, with all their columns."""
    ready(spark)
    shared = spark.sparkContext.broadcast(language_model(docs))
    weights = learn(docs, read(spark, sf_dir, "labels"))
    return docs.mapInArrow(_clean(weights, shared), docs.schema)
