"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib

import pytest

from panelloom.llm import prefixes

SCHEMA = "conv_id bigint, turn bigint, role string, text string, id string, depth int, said int"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole = tuple(turns.get(base, [])[:h] + mine[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(prefixes.WORD, path[-1][1])) if path else 0
        leaves[path] += path not in kids
        saved[path] += (len(members[path]) - 1) * words
        if path:
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p],
         sha(",".join(map(str, sorted(ends.get(p, []))))))
        for p, m in members.items()
    )


def found(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = prefixes.prefix_trie(frame)
    assert got.columns == list(FIELDS)
    assert {t for n, t in got.dtypes if n != "ends_sha256"} == {"bigint"}
    return sorted(tuple(-1 if v is None else v for v in r) for r in got.collect())


ODD = [
    (0, 0, "user", "one two"), (0, None, None, "no turn"), (0, 1, "assistant", None), (0, 1, "assistant", None),
    (1, 0, "user", "one two"), (1, 0, "user", "a tie"), (1, 5, "", ""), (7, 1, "user", "x" * 200_000),
    (19, 3, "user", "\x0b\t "), (20, 0, "user", "one two"), (25, 0, "user", "one two"), (33, 0, "a", "word  word"),
    (None, 0, "user", "nobody"), (-3, 0, "user", "one two"), (-3, 1, "user", "é   é"), (-45, 0, "user", "one two"),
]


def test_odd_rows(spark):
    assert found(spark, ODD) == brute(ODD)


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [(None, 0, "user", "nobody")]) == []


@pytest.mark.parametrize("band", [2, 16])
def test_random_conversations_of_many_bands(spark, monkeypatch, band):
    monkeypatch.setattr(prefixes, "BAND", band)
    rng = random.Random(band)
    longest = 40 if band == 2 else 300
    trunk = [(rng.choice(["user", "assistant"]), rng.choice(["a", "a b", "c d e", ""])) for _ in range(longest)]
    rows = []
    for c in rng.sample(range(400), 30):
        branch = rng.randrange(longest)
        for i in range(rng.choice([1, 2, 5, longest - 3, longest])):
            role, text = trunk[i] if i < branch else (rng.choice(["user", "assistant"]), rng.choice("xy"))
            rows.append((c, i, role, text))
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_hot_turns_and_ends_in_pieces(spark, monkeypatch):
    """Most conversations are the same one, named in several pieces, and one holds a third of all rows."""
    monkeypatch.setattr(prefixes, "PIECE", 8)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 4000, 20) for t in range(2)]
    rows += [(3, t, "user", "again and again") for t in range(200)]
    rows += [(5, 0, "user", "the same row") for _ in range(100)]
    assert found(spark, rows) == brute(rows)
