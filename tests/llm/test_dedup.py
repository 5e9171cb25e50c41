"""Exact and near dedup against brute force."""

import hashlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from panelloom.llm import components, exact, simhash
from panelloom.llm.common import read
from panelloom.llm.fingerprints import Hasher
from tests.llm.conftest import LARGER, ODD


def slow_print(text):
    words = [w for w in (text or "").encode().lower().split() if w]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """component_id by comparing all pairs of different fingerprints."""
    prints = sorted({p for _, p in rows})
    values = np.array(prints, np.uint64)
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    lowest = defaultdict(list)
    where = {p: i for i, p in enumerate(prints)}
    for doc_id, p in rows:
        if doc_id is not None:
            lowest[find(where[p])].append(doc_id)
    return sorted(
        ((d, f"{p:016x}", min(lowest[find(where[p])], default=None)) for d, p in rows), key=lambda r: (r[0] is None, r)
    )


def check_near(frame):
    rows = [(r["doc_id"], slow_print(r["text"])) for r in frame.select("doc_id", "text").collect()]
    got = [tuple(r) for r in simhash.near_duplicates(frame).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r)) == slow_components(rows)


def test_near_duplicates_of_odd_rows(docs_of):
    check_near(docs_of(ODD))
    check_near(docs_of([]))


def test_near_duplicates_of_the_table(spark):
    check_near(read(spark, LARGER, "documents"))


def test_links_of_a_large_shard(spark, monkeypatch):
    """Tiles: one cluster of many prints in one shard, and a chain through it."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    prints = {base}
    while len(prints) < 400:
        p = base
        for b in rng.choice(30, 3, replace=False):
            p ^= 1 << int(b)
        prints.add(p)
    chain = [base ^ (((1 << 4 * k) - 1) << 31) for k in range(1, 8)]
    prints = sorted(prints | set(chain))
    monkeypatch.setattr(simhash, "TILE", 64)
    frame = spark.createDataFrame([(p,) for p in prints], "print bigint")
    links = simhash.links(frame)
    assert links.count() < 15 * len(prints) * 10
    assert {r["root"] for r in components.components(links).collect()} == {min(prints)}


def test_bk_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    points = np.unique(base[rng.integers(0, 20, 300)] ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64)))
    parent, edge = simhash.build_tree(points)
    assert (parent[1:] >= 0).all()
    asked, found = simhash.search_tree(points, parent, edge, points, 4)
    wanted = np.argwhere(np.bitwise_count(points[:, None] ^ points[None, :]) <= 4)
    assert sorted(zip(asked.tolist(), found.tolist())) == sorted(map(tuple, wanted.tolist()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_near_stage_keeps_one_of_each(spark, docs_of):
    docs = docs_of(ODD)
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    got = simhash.near_duplicates(docs).collect()
    assert sorted(set(ids)) == sorted({r["component_id"] for r in got if r["component_id"] is not None})


def test_near_stage_against_all_pairs(spark):
    docs = read(spark, LARGER, "documents")
    hasher = Hasher()
    sets = {r.doc_id: set(hasher.shingles(r.text or "").tolist()) for r in docs.collect()}
    holders = {}
    for doc_id, shingles in sets.items():
        for shingle in shingles:
            holders.setdefault(shingle, []).append(doc_id)
    shared = Counter(pair for ids in holders.values() for pair in combinations(sorted(ids), 2))
    alike = {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in shared.items()}
    kept = {r.doc_id for r in simhash.stage(spark, docs, "").select("doc_id").collect()}
    near = [pair for pair, share in alike.items() if share >= 0.8]
    missed = [pair for pair in near if kept.issuperset(pair)]
    assert len(near) > 50 and len(missed) <= 0.02 * len(near)
    # What went has a likeness to something: no clean document is lost.
    close = {i for pair, share in alike.items() if share >= 0.45 for i in pair}
    assert all(i in close or not sets[i] for i in sets.keys() - kept)


def test_near_stage_with_shards_of_several_tiles(spark, docs_of, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:i] + ["changed"] + base[i + 1 :])) for i in range(100)]
    rows += [(1_000 + i, " ".join(f"x{i}y{j}" for j in range(50))) for i in range(20)]
    kept = sorted(r.doc_id for r in simhash.stage(spark, docs_of(rows), "").collect())
    assert kept == [0, *range(1_000, 1_020)]


def test_near_stage_of_nothing(spark, docs_of):
    assert simhash.stage(spark, docs_of([(1, "a")]).limit(0), "").count() == 0


def test_near_stage_keeps_unlike_texts_without_or_with_one_id(spark, docs_of):
    unlike = ["the first text is about trees and rivers", "prices of copper rose again in march", "él no sabe nada de eso"]
    rows = [(None, t) for t in unlike] + [(None, unlike[0])] + [(7, "a song of the sea at night"), (7, "how to bake bread at home")]
    rows += [(3, "seven blue ships went out"), (3, "no two of these are alike"), (8, "seven blue ships went out")]
    kept = simhash.stage(spark, docs_of(rows), "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(set(rows[:-1]), key=str)


def slow_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[hashlib.sha256((text or "").encode().lower()).hexdigest()].append(doc_id)
    out = []
    for digest, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        seen = False
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((i, keep, len(ids), i == keep and not seen, digest))
            seen = seen or i == keep
    return sorted(out, key=str)


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_exact_dedup_of_odd_rows(docs_of, share):
    got = exact.exact_dedup(docs_of(ODD), exact.seen_before(share)).collect()
    assert sorted((tuple(r) for r in got), key=str) == slow_exact(ODD)


def test_exact_dedup_of_nothing_and_hot_group(docs_of):
    assert exact.exact_dedup(docs_of([])).collect() == []
    rows = [(i, "same" if i % 3 else f"text {i}") for i in range(300)]
    assert sorted((tuple(r) for r in exact.exact_dedup(docs_of(rows)).collect()), key=str) == slow_exact(rows)


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_exact_buckets_grow_with_either_side(docs_of, monkeypatch, share):
    used, merge = [], exact.merge_groups
    monkeypatch.setattr(exact, "BUCKET_KEYS", 10)
    monkeypatch.setattr(exact, "merge_groups", lambda i, n, buckets: used.append(buckets) or merge(i, n, buckets))
    rows = [(i, f"text {i % 95}") for i in range(190)]
    got = exact.exact_dedup(docs_of(rows), exact.seen_before(share)).collect()
    assert sorted((tuple(r) for r in got), key=str) == slow_exact(rows)
    assert used == [10]


def test_exact_stage(spark, docs_of):
    docs = docs_of(ODD)
    kept = exact.stage(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    # One row per distinct text; 5 and 4 are equal, 5 comes twice, 1 and 2 are both empty.
    assert len(got) == len({(t or "").encode().lower() for _, t in ODD})
    assert (5, "one TWO three four five six.") in got and (4, "One two three four five six.") not in got
    assert (2, "") in got and (1, None) not in got


def test_perfect_hash_is_minimal_and_byte_checked():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    levels, slots = exact.perfect_hash(keys[:4000])
    assert sorted(slots.tolist()) == list(range(4000))
    stored = keys[:4000][np.argsort(slots)]
    assert (exact.find_slots(levels, stored, keys[:4000]) == slots).all()
    assert (exact.find_slots(levels, stored, keys[4000:]) == -1).all()
