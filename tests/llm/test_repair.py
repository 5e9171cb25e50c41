"""Conversation repair against a search over all edits, row by row."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from panelloom.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, signature string, audit int, copies string"
FIELDS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
GRAMMAR = re.compile(r"(s?(ua)+)?")
PARTIAL = re.compile(r"s?(ua)*u?")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damage(rows):
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        yield from [(c, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)


def cheapest(rows, faults):
    """Least (cost, audit) over all edits, with the repaired rows; roles so far decide what may follow."""
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, initials, out = heapq.heappop(queue)
        if i == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, audit, out
        key = (i, initials[-1:], initials[:1] == "" if len(initials) < 2 else None)
        if key in seen:
            continue
        seen.add(key)
        ahead = [(3, "I", r, "", 0) for r in ("user", "assistant")]
        if i < len(rows):
            role, text = rows[i]
            ahead.append((4, "D", None, None, 1))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                ahead.append((extra, "K", role, text, 1))
                ahead += [(3 + extra, "R", r, text, 1) for r in ("user", "assistant")]
        for price, letter, role, text, step in ahead:
            now = initials if role is None else initials + (role[:1] or "?")
            if PARTIAL.fullmatch(now):
                heapq.heappush(queue, (cost + price, audit + letter, i + step, now, out if role is None else (*out, (role, text))))
    raise AssertionError("no repair")


def brute(rows):
    found, after = [], {}
    for c, turn, role, text in damage(rows):
        after.setdefault(c, []).append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    for c in {r[0] for r in rows}:
        mine = sorted(after.get(c, []))
        turns = {t for known, t, *_ in mine if known}
        lines, faults, seen = [x[3:] for x in mine], [], set()
        for role, text in lines:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated")
            seen.add((role, text))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        cost, audit, out = cheapest(lines, faults)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        found.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                      sha("\n".join(f"{r}:{t}" for r, t in out))))
    return sorted(found, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def found(spark, rows):
    got = repair.repair_digests(frame(spark, rows))
    return sorted((tuple(r[f] for f in FIELDS) for r in got.collect()), key=str)


ODD = [
    (1, None, None, None), (1, None, "user", ""), (1, 3, "", "No role."), (1, 9, "assistant", "x" * 300_000 + "."),
    (1, 9, "assistant", "x" * 300_000 + "."), (1, 9, "assistant", "tie"), (2, None, "user", "all null."),
    (None, 0, "user", "nobody."), (None, None, "assistant", None), (3, 1, "system", " \x0b"), (3, 2, "Sam", "é?"),
    (4, -5, "user", "Why? \n"), (4, 7, "assistant", "Done.\t"), (5, 0, "tool", "odd role."), (6, 2, "user", "\xa0"),
]


def test_odd_rows(spark):
    assert found(spark, ODD) == brute(ODD)
    assert found(spark, []) == [] and repair.repair_turns(frame(spark, [])).collect() == []


def test_conversations_that_lose_all_rows(spark):
    rows = [(c, 0, "user", "One.") for c in range(60)]
    gone = [r for r in found(spark, rows) if r[7] == "" and r[8] == sha("")]
    assert found(spark, rows) == brute(rows)
    assert {c for c, *_ in gone} >= {c for c in range(60) if zlib.crc32(f"{c}:0".encode()) % 20 == 0} and gone


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(150):
        for t in range(rng.randrange(1, 11)):
            role = rng.choice(["user", "assistant"] * 3 + ["system", "tool"])
            rows.append((c, rng.choice([t, t, t + 5, None]), role, rng.choice(["Yes.", "No", "So?", "", " ", f"Text {t}!"])))
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_long_and_hot_conversations(spark):
    """One conversation holds a third of all rows; most others share one signature."""
    rows = [(7, t, "user" if t % 3 else "assistant", f"Turn {t}{'.' * (t % 4)}") for t in range(400)]
    rows += [(100 + c, t, ["user", "assistant"][t % 2], f"Line {t}.") for c in range(200) for t in range(4)]
    assert found(spark, rows) == brute(rows)


def test_every_suffix_costs_what_a_search_finds():
    rng = random.Random(3)
    initials = ["system", "user", "assistant", "tool"]
    names = ["", "blank", "duplicate", "truncated"]
    for _ in range(300):
        codes = [(rng.randrange(4), rng.randrange(4)) for _ in range(rng.randrange(8))]
        node = repair.end_node()
        for i, f in reversed(codes):
            node = repair.extend(node, repair.SYMBOLS[i * 4 + f])
        cost, audit, _ = cheapest([(initials[i], "t") for i, _ in codes], [names[f] for _, f in codes])
        assert (node.cost[0], repair.written(node.audit[0])) == (cost, audit)


def test_repaired_turns_give_the_digests(spark):
    rows = [r for r in ODD if r[0] is not None] + [(8, t, "user", f"Again {t}.") for t in range(5)]
    turns = {}
    for r in repair.repair_turns(frame(spark, rows)).orderBy("conv_id", "place").collect():
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in repair.repair_digests(frame(spark, rows)).collect():
        assert sha("\n".join(turns.get(r["conv_id"], []))) == r["repaired_sha256"]
