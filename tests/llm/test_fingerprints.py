"""Fingerprints against sets of word tuples, ring order and edits by plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest

from panelloom.llm import fingerprints as fp
from panelloom.llm.common import read
from tests.llm.conftest import LARGER, ODD


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles_of(text):
    words = words_of(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def true_jaccard(a, b):
    a, b = shingles_of(a), shingles_of(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(spark, rows, found):
    """Every row against its text; order among ties by text key, taken from Spark."""
    keys = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS k")
    ring = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["k"], r["text"]) for r in keys.collect())
    expected, errors = [], []
    hasher = fp.Hasher()
    for (known, doc_id, _, text), (*_, after) in zip(ring, ring[1:] + ring[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, behind = (hasher.fingerprint(hasher.shingles(t)) for t in (text, edited, after))
        near = fp.likeness(own, changed), fp.likeness(own, behind)
        errors += [near[0] - true_jaccard(text, edited), near[1] - true_jaccard(text, after)]
        expected.append((doc_id if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest(),
                         fp._packed(own).hex(), fp._packed(changed).hex(), *near))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    # One estimate has a standard error of 0.044 at most.
    assert np.abs(errors).max() < 0.25 and np.abs(np.mean(errors)) < 4 * 0.044 / len(errors) ** 0.5


def hexed(frame):
    return frame.selectExpr("doc_id", "n_chars", "edited_sha256", "lower(hex(fingerprint))", "lower(hex(edited_fingerprint))", "near_edited", "near_next").collect()


def test_odd_rows(spark, docs_of):
    check(spark, ODD, hexed(fp.fingerprints(docs_of(ODD))))


@pytest.mark.parametrize("rows", [[], [(5, "only one here to be its own next document")], [(None, None)]])
def test_small_tables(spark, docs_of, rows):
    found = hexed(fp.fingerprints(docs_of(rows)))
    assert len(found) == len(rows)
    if rows:
        check(spark, rows, found)


def test_query_on_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, LARGER, "documents").collect()]
    found = fp.op13_fingerprints(spark, LARGER)
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    check(spark, rows, found.collect())


def test_shingle_hashes_tell_sets_apart():
    rng = random.Random(5)
    hasher, texts = fp.Hasher(), set()
    for _ in range(3_000):
        texts.add(" ".join(rng.choice(["a", "b", "ab", "ba", "É", "x" * 70, "0"]) for _ in range(rng.randrange(1, 7))))
    by_hash = {}
    for t in texts:
        by_hash.setdefault(frozenset(hasher.shingles(t).tolist()), set()).add(frozenset(shingles_of(t)))
    assert all(len(v) == 1 for v in by_hash.values())
    assert len(by_hash) == len({frozenset(shingles_of(t)) for t in texts})
    spaced = "One  TWO\tthree\nfour five six"
    assert hasher.shingles(spaced).tolist() == hasher.shingles(" one two three four five six ").tolist()


def linked(rows):
    """Components of Jaccard >= NEAR by comparing all pairs."""
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if true_jaccard(rows[i][1], rows[j][1]) >= fp.NEAR:
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return {doc_id: least[top(i)] for i, (doc_id, _) in enumerate(rows)}


def test_near_copies_against_all_pairs(spark, docs_of, monkeypatch):
    """Chains of edits: neighbours are near, ends are not; one group holds a third of all rows."""
    monkeypatch.setattr(fp, "TOGETHER", 7)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for length in (1, 1, 2, 5, 12, 60):
        words = [word() for _ in range(150)]
        for _ in range(length):
            rows.append((len(rows) * 3 + 1, " ".join(words)))
            words[rng.randrange(150)] = word()
    rows += [(1000 + i, rows[-1][1]) for i in range(50)] + [(2000, ""), (2001, " \n"), (2002, "few words")]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["near_id"] for r in fp.near_copies(docs_of(rows)).collect()}
    want = linked(rows)
    assert sum(got[d] == want[d] for d in want) / len(want) > 0.95 and len(got) == len(rows)
    assert all(want[got[d]] == want[d] for d in want)  # no link that is none


def test_near_copies_of_odd_rows(spark, docs_of):
    found = fp.near_copies(docs_of(ODD)).collect()
    assert len(found) == len(ODD) and fp.near_copies(docs_of([])).collect() == []
    near = {}
    for r in found:
        near.setdefault(r["doc_id"], []).append(r["near_id"])
    assert near[2] == near[3] == near[1] == [1] and near[7] == [7] and near[4] == [4] and sorted(near[5]) == [4, 4, 5]
