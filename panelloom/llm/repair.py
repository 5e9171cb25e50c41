"""Cheapest repair of damaged conversations through an automaton of shared suffixes.

Each row of a conversation becomes one symbol, its role's initial and its first
fault, and the conversation a signature. Distinct signatures are range-sorted
from their ends, so that those with a common suffix are neighbours: a stream
over them is a walk along the automaton whose nodes are the distinct suffixes.
Each node is met once (once more where a range begins) and holds, for every
state of the grammar, the cost to go and the best audit, which is one letter in
front of the audit of another node; no audit is written out before it is asked
for. Conversations take their audit by a join on the signature.

The first letters of a state's choices differ, so the least audit among the
cheapest starts with the least letter among them, and no audits are compared.

Edge cases: null roles and texts are one space; so are a null conv_id and turn
in the key that picks the damage, and rows without a conv_id are one
conversation. Rows sort by turn, nulls first, then by the SHA-256 of role length,
role and text after damage; rows repeated whole are rows of their own. Other
roles than user, assistant and system are told by their initials alone. Turns
whose span no long can hold have null gaps. An empty table gives no rows. Other
columns are ignored. Signature and audit hold a letter per row in one value each,
which bounds a conversation; its texts are streamed.
"""

from __future__ import annotations

import hashlib
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import attach, cut_lineage, read
from panelloom.llm.prefixes import CRC_TABLE, crc32_sql

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "abcdefghijklmnop"  # four initials by four faults
INITIALS = "sua"  # the fourth stands for all others
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
DELETE, CHANGE, INSERT, CUT_OFF = 4, 3, 3, 3

# States of the grammar (s?(ua)+)?: at the start, after s, after u, after a.
NEXT = [{0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2}]
WANTED = [2, 2, 3, 2]  # the state behind the only initial that may be put in
ROLE_OF = {2: "user", 3: "assistant"}
LEGAL = {(0, 1), (1, 2), (2, 1)}
COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]
FIGURES = ["gaps", *COUNTS]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): how often each row stands in the damaged conversation."""
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("bigint").cast("string"), F.lit(" ")),
        F.lit(":"),
        F.coalesce(F.col("turn").cast("bigint").cast("string"), F.lit(" ")),
    )
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def said() -> Column:
    return F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, signature) of damaged rows, one per conversation; texts stay where they are."""
    stripped = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(stripped == "", BLANK).when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    known = F.when((initial > 0) & (F.col("role") != ""), initial - 1).otherwise(len(INITIALS))
    seen = F.struct(said().alias("said"), "turn", known.alias("initial"), fault.alias("fault"))
    collected = rows.groupBy("conv_id").agg(F.sort_array(F.flatten(F.collect_list(F.array_repeat(seen, F.col("copies"))))).alias("by_said"))

    def symbol(x: Column, i: Column) -> Column:
        again = (i > 0) & (F.get("by_said", i - 1)["said"] == x["said"])
        number = x["initial"] * 4 + F.when(again & (x["fault"] != BLANK), DUPLICATE).otherwise(x["fault"])
        # The place keeps the first of equal rows first.
        return F.struct(x["turn"].alias("turn"), x["said"].alias("said"), i.alias("place"), F.substr(F.lit(SYMBOLS), number + 1, F.lit(1)).alias("symbol"))

    ordered = collected.select("conv_id", F.sort_array(F.transform("by_said", symbol)).alias("rows"))
    turns = F.array_distinct(F.filter(F.col("rows.turn"), lambda t: t.isNotNull()))
    span = F.expr("try_add(try_subtract(array_max(turns), array_min(turns)), 1L - size(turns))")
    return (
        ordered.select("conv_id", F.array_join("rows.symbol", "").alias("signature"), turns.alias("turns"))
        .select("conv_id", "signature", F.when(F.size("turns") == 0, F.lit(0).cast("bigint")).otherwise(span).alias("gaps"))
    )


class Node:
    """A suffix: counts of its faults, and by state the cost to go and the audit as (letter, rest)."""

    __slots__ = ("audit", "cost", "counts", "initial")

    def __init__(self, cost, audit, counts, initial) -> None:
        self.cost, self.audit, self.counts, self.initial = cost, audit, counts, initial


def end_node() -> Node:
    one = ("I", None)
    return Node([0, 2 * INSERT, INSERT, 0], [None, ("I", one), one, None], (0, 0, 0, 0), None)


def extend(node: Node, symbol: str) -> Node:
    """The node of one more symbol in front."""
    initial, fault = divmod(SYMBOLS.index(symbol), 4)
    cost, audit = [], []
    for state in range(4):
        choices = [(node.cost[state] + DELETE, "D", state)]
        if fault not in (BLANK, DUPLICATE):
            extra = CUT_OFF if fault == TRUNCATED else 0
            kept, changed = NEXT[state].get(initial), WANTED[state]
            if kept is not None:
                choices.append((node.cost[kept] + extra, "K", kept))
            choices.append((node.cost[changed] + extra + CHANGE, "R", changed))
        best, letter, then = min(choices)
        cost.append(best)
        audit.append((letter, node.audit[then]))
    # Two in a row are cheapest only after s, so "after u" and "after a" look at each other's plain costs.
    plain = list(zip(cost, audit))
    for state in (2, 3, 0, 1):
        through = plain[WANTED[state]] if state > 1 else (cost[2], audit[2])
        if (through[0] + INSERT, "I") < (cost[state], audit[state][0]):
            cost[state], audit[state] = through[0] + INSERT, ("I", through[1])
    counts = list(node.counts)
    if fault != FINE:
        counts[fault - 1] += 1
    counts[3] += node.initial is not None and (initial, node.initial) not in LEGAL
    return Node(cost, audit, tuple(counts), initial)


def written(audit) -> str:
    letters = []
    while audit is not None:
        letter, audit = audit
        letters.append(letter)
    return "".join(letters)


def _walk(batches):
    """Audits of signatures that arrive sorted from their ends; the path holds the nodes of the last one."""
    names = ["signature", *COUNTS, "audit"]
    types = [pa.string(), *[pa.int64()] * len(COUNTS), pa.string()]
    path, last = [end_node()], ""
    for batch in batches:
        out = []
        for signature in batch.column("signature").to_pylist():
            backwards = signature[::-1]
            shared, most = 0, min(len(backwards), len(last))
            while shared < most and backwards[shared] == last[shared]:
                shared += 1
            del path[shared + 1 :]
            for symbol in backwards[shared:]:
                path.append(extend(path[-1], symbol))
            last = backwards
            out.append((signature, *path[-1].counts, path[-1].cost[0], written(path[-1].audit[0])))
        columns = list(zip(*out)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def audits(signed: DataFrame) -> DataFrame:
    """Add counts, cost and audit to (conv_id, gaps, signature)."""
    counted = cut_lineage(signed.groupBy("signature").agg(F.count("*").alias("n")))
    backwards = F.reverse("signature")
    ordered = counted.select("signature").repartitionByRange(backwards).sortWithinPartitions(backwards)
    schema = "signature string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string"
    walked = cut_lineage(ordered.mapInArrow(_walk, schema))
    # Hot signatures are short or few; their sizes decide which way their conversations take.
    return attach(signed, walked, "signature", "n", counted.select("signature", "n"))


def _repaired(rows, audit):
    """(role, text) of a repaired conversation from its rows (role, text) in order, as a stream."""
    state, at = 0, 0

    def put_in():
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            state, at = WANTED[state], at + 1
            yield ROLE_OF[state], ""

    for role, text in rows:
        yield from put_in()
        letter, at = audit[at], at + 1
        if letter == "K":
            state = NEXT[state][INITIALS.index(role[0])]
            yield role, text
        elif letter == "R":
            state = WANTED[state]
            yield ROLE_OF[state], text
    yield from put_in()


def _conversations(batches):
    """(first row, iterator over the others as (role, text)) of each conversation, streamed."""
    names = ["conv_id", "marked", "role", "text", "audit", *FIGURES]
    stream = (row for b in batches for row in zip(*[b.column(n).to_pylist() for n in names]))
    ahead = next(stream, None)

    def others():
        nonlocal ahead
        ahead = next(stream, None)
        while ahead is not None and not ahead[1]:
            yield ahead[2], ahead[3]
            ahead = next(stream, None)

    while ahead is not None:
        rest = others()
        yield ahead, rest
        for _ in rest:
            pass


def _turns(batches):
    """The repaired turns, a few thousand to a batch."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    out, held = [], 0
    for mark, rows in _conversations(batches):
        for place, (role, text) in enumerate(_repaired(rows, mark[4])):
            out.append((mark[0], place, role, text))
            held += len(text)
            if len(out) >= 2_000 or held > 4 << 20:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o)) for o in out], schema)
                out, held = [], 0
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o)) for o in out], schema)


def _digests(batches):
    """One row per conversation with the digest of its repaired turns."""
    names = ["conv_id", *FIGURES, "audit", "repaired_sha256"]
    types = [pa.int64(), *[pa.int64()] * len(FIGURES), pa.string(), pa.string()]
    out = []

    def batch():
        columns = list(zip(*out)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    for mark, rows in _conversations(batches):
        digest, first = hashlib.sha256(), True
        for role, text in _repaired(rows, mark[4]):
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        out.append((mark[0], *mark[5:], mark[4], digest.hexdigest()))
        if len(out) >= 2_000:
            yield batch()
            out = []
    yield batch()


def _streamed(rows: DataFrame) -> DataFrame:
    """Damaged rows in order, each conversation behind a row with its figures and audit."""
    signed = cut_lineage(signatures(rows))
    marks = audits(signed).select("conv_id", F.lit(True).alias("marked"), "audit", *FIGURES)
    lines = rows.select(
        "conv_id", F.lit(False).alias("marked"), "turn", "role", "text", said().alias("said"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"),
    ).drop("copy")
    both = marks.unionByName(lines, allowMissingColumns=True)
    order = ["conv_id", F.desc("marked"), F.asc_nulls_first("turn"), "said"]
    return both.repartition("conv_id").sortWithinPartitions(*order)


def repair_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired turns of conversations damaged as ``damaged`` says."""
    return _streamed(damaged(rows)).mapInArrow(_turns, "conv_id bigint, place bigint, role string, text string")


def repair_digests(rows: DataFrame) -> DataFrame:
    """Figures, audit and digest of each conversation, as the query returns them."""
    schema = "conv_id bigint, " + ", ".join(f"{c} bigint" for c in FIGURES) + ", audit string, repaired_sha256 string"
    return _streamed(damaged(rows)).mapInArrow(_digests, schema)


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest edits and repaired digests of all conversations."""
    return repair_digests(read(spark, folder, "conversations"))


def _option(state: int, letter: str, cost: str) -> str:
    return f"{{'c': b{state}.c + {cost}, 'a': '{letter}' || b{state}.a}}"


def _choices(state: int) -> str:
    kept = " ".join(f"WHEN initial = '{INITIALS[i]}' THEN [{_option(to, 'K', 'extra')}]" for i, to in NEXT[state].items())
    more = f"[{_option(WANTED[state], 'R', f'{CHANGE} + extra')}] || CASE {kept} ELSE [] END"
    return f"list_min([{_option(state, 'D', str(DELETE))}] || CASE WHEN fault IN ('blank', 'duplicate') THEN [] ELSE {more} END) AS o{state}"


ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind
  FROM conversations, crc_table),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM src JOIN range(2) AS r(copy) ON copy < CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END),
ord AS (
  SELECT *, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i
  FROM hurt),
told AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM ord),
dp AS (
  SELECT conv_id, count(*) + 1 AS i, {{'c': 0, 'a': ''}} AS f0, {{'c': 6, 'a': 'II'}} AS f1, {{'c': 3, 'a': 'I'}} AS f2,
    {{'c': 0, 'a': ''}} AS f3
  FROM told GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, least(o0, {{'c': f2.c + 3, 'a': 'I' || f2.a}}), least(o1, {{'c': f2.c + 3, 'a': 'I' || f2.a}}), f2, f3
  FROM (
    SELECT conv_id, i, o0, o1, least(o2, {{'c': o3.c + 3, 'a': 'I' || o3.a}}) AS f2,
      least(o3, {{'c': o2.c + 3, 'a': 'I' || o2.a}}) AS f3
    FROM (
      SELECT conv_id, i, {", ".join(_choices(q) for q in range(4))}
      FROM (
        SELECT t.conv_id, t.i, t.initial, t.fault, CASE WHEN t.fault = 'truncated' THEN 3 ELSE 0 END AS extra,
          d.f0 AS b0, d.f1 AS b1, d.f2 AS b2, d.f3 AS b3
        FROM dp d JOIN told t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.i = d.i - 1)))),
best AS (SELECT conv_id, f0.c AS cost, f0.a AS audit FROM dp WHERE i = 1),
edits AS (
  SELECT conv_id, p, letter, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS i,
    sum(CASE WHEN letter = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS place
  FROM (SELECT conv_id, p, audit[p] AS letter FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best))),
lines AS (
  SELECT e.conv_id, p, letter, place, t.role, CASE WHEN letter = 'I' THEN '' ELSE t.text END AS text, t.initial,
    bool_or(letter = 'K' AND place = 1 AND t.initial = 's') OVER (PARTITION BY e.conv_id) AS system
  FROM edits e LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.i = e.i
  WHERE letter <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role
      WHEN (place - CASE WHEN system THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
    chr(10) ORDER BY p) AS text
  FROM lines GROUP BY conv_id),
counted AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM told GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
  LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""
