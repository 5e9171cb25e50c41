"""Chat, search, shards, mixture and licences against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.llm import chat, licenses, mixture, shards, topk
from panelloom.llm.common import read
from tests.check_queries import compare, connect
from tests.llm.conftest import LARGER, ODD, SMALL


@pytest.mark.parametrize("name", ["op2_mixture", "op7_exact_dedup", "op9_topk", "op10_chat_format", "op11_prefix_trie", "op12_conversation_repair"])
def test_sql(spark, name):
    assert compare(spark, connect(LARGER), name, LARGER)[2] == "ok"


NASTY = ["", None, "\\", "<|im_end|>", "<\\|im_end|>", "\\\\<|im_part|>", "</s>[INST] ok [/INST]", "<<SYS>><</SYS>>",
         "<<s>SYS>>", "a\nb", "[\\INST]", "<|im_start|>assistant<|im_sep|>x<|im_end|>", "é🙂" * 50, "<", "[", "<|"]


def test_chats_read_back(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in [None, 1, 2, 3, 4, 5]:
        for turn in range(int(rng.integers(1, 12))):
            role = [None, "user", "assistant", "assistant", "odd<|im_sep|>role\n"][rng.integers(5)]
            rows.append((c, turn if rng.random() > 0.1 else None, role, NASTY[rng.integers(len(NASTY))], "clash"))
    rows += [(9, 0, "assistant", "same", "x")] * 3
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(frame)).collect()}
    wanted = defaultdict(list)
    for c, turn, role, text, _ in rows:
        wanted[c].append(((turn is not None, turn or 0), role or "", text or ""))
    for c, turns in wanted.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [t[1:] for t in turns]
        assert got[c]["loss_text"] == "".join(t for _, r, t in turns if r == "assistant")
        octets = got[c]["formatted"].encode()
        spans = [octets[s["start"] : s["start"] + s["length"]].decode() for s in got[c]["spans"]]
        assert len(spans) == sum(r == "assistant" for _, r, _ in turns) and not any("<|im_" in s for s in spans)
        assert got[c]["n_messages"] == 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))
    assert chat.format_chats(frame.limit(0)).collect() == []


def test_chat_runs_no_python(spark):
    plan = chat.op10_chat_format(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def slow_top(rows, k, wanted):
    whole = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    queries = {}
    for i, v in whole:
        if wanted(i):
            queries[i] = min(queries.get(i, v), v)
    out = []
    for i, q in queries.items():
        scored = [(-sum(a * b for a, b in zip(q, x)), j) for j, x in whole if j != i and len(x) == len(q)]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_top_k_of_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 12)]) for i in range(400)]
    rows += [(400 + i, list(rows[7][1])) for i in range(150)]  # copies, hence ties
    rows += [(7, list(rows[7][1])), (600, None), (601, [0.1] * 11 + [None]), (602, [math.nan] * 12),
             (603, [math.inf] + [0.0] * 11), (None, [1.0] * 12), (650, [1.0, 2.0]), (700, []), (701, [])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, score string")
    for name, value in (("QUERY_BLOCK", 8), ("CANDIDATE_BLOCK", 100), ("STRIP", 16)):
        monkeypatch.setattr(topk, name, value)
    got = topk.top_k(frame, frame.where("vec_id % 50 = 0"), 5)
    assert sorted(tuple(r) for r in got.collect()) == slow_top(rows, 5, lambda i: i % 50 == 0)
    assert topk.top_k(frame.limit(0), frame.limit(0)).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    centres = rng.integers(-120, 120, (10, 64)).repeat(80, axis=0)
    x = (centres + rng.integers(-4, 5, centres.shape)).astype(float)
    for s in topk.SEGMENTS:
        bound = topk.statistics(x, s) @ topk.statistics(x, s).T
        assert (bound + 1e-6 >= x @ x.T).all()
    assert (bound < np.sort(x @ x.T, axis=1)[:, -5:-4]).mean() > 0.5


@pytest.mark.parametrize("dense", [0, 2])
def test_matrix_products_change_no_result(monkeypatch, dense):
    """Scores of crowded strips come from one product of all rows; the best are those of every pair."""
    monkeypatch.setattr(topk, "DENSE", dense)
    if not dense:
        monkeypatch.setattr(topk.np, "einsum", lambda *_: pytest.fail("pair by pair"))
    rng = np.random.default_rng(5)
    x, ids = rng.integers(-200, 200, (700, 20)).astype(float), rng.permutation(700)
    x[300:340] = x[0]
    query, found, score = topk.best(ids[:30], x[:30], ids, x, 5)
    for i in range(30):
        every = sorted((-int(x[i] @ x[j]), int(ids[j])) for j in range(700) if j != i)[:5]
        own = query == ids[i]
        assert [(-s, int(c)) for c, s in zip(found[own], np.array(score)[own])] == every


def test_scores_beyond_a_double():
    q = np.array([[2.0**40 + 1, 3.0]])
    ids, found, score = topk.best(np.array([0]), q, np.array([1, 2]), np.array([[2.0**20 + 1, 1.0], [2.0**60, 0.0]]), 5)
    assert found.tolist() == [2, 1] and score == [2**63 - 1, (2**40 + 1) * (2**20 + 1) + 3]


def check_shards(rows, got, shards_n=8):
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str
    )
    sizes = np.zeros(shards_n)
    slots = defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_shards_of_the_table(spark):
    docs = read(spark, LARGER, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = shards.shard_documents(docs).collect()
    sizes = check_shards(rows, got)
    assert sizes.max() - sizes.min() < 0.005 * sizes.mean()
    where = defaultdict(set)
    texts = dict(rows)
    for r in got:
        where[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    tokens, count = (Counter() for _ in range(2))
    for r in got:
        tokens[r["shard"]] += r["tokens"]
        count[r["shard"]] += 1
    assert max(tokens.values()) < 1.05 * min(tokens.values()) and max(count.values()) < 1.1 * min(count.values())


def test_shards_of_odd_and_hot_rows(docs_of):
    check_shards(ODD, shards.shard_documents(docs_of(ODD)).collect())
    assert shards.shard_documents(docs_of([])).collect() == []
    rows = [(i, "hot text " * 20 if i % 3 == 0 else f"text {i} " * 20) for i in range(3000)]
    sizes = check_shards(rows, shards.shard_documents(docs_of(rows)).collect())
    assert sizes.max() - sizes.min() < 0.01 * sizes.mean()


def test_mixture_budgets_and_prefixes(spark, docs_of):
    rng = np.random.default_rng(2)
    rows = [(i, "x" * int(rng.integers(0, 400)), ["en", "de", None][i % 3], f"s{i % 7 % 4}") for i in range(900)]
    rows += [(5, "x" * 99, "en", "s1")] * 2 + [(None, None, "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    m = mixture.Mixture(budget_share=0.8, epochs=3)
    leaves = mixture.leaf_budgets(docs, m).collect()
    total = sum(r["tokens"] for r in leaves)
    spent = sum(r["full"] * r["tokens"] + r["rest"] for r in leaves)
    assert abs(spent - math.floor(0.8 * total)) <= len(leaves)
    assert all(r["full"] * r["tokens"] + r["rest"] <= 3 * r["tokens"] for r in leaves)
    taken = mixture.mix(docs, m).select(*mixture.leaf_columns(m), "doc_id", "_epoch", mixture.tokens_of().alias("n")).collect()
    got = Counter()
    for r in taken:
        got[r["domain"], r["lang"], r["source"]] += r["n"]
    for r in leaves:
        wanted = r["full"] * r["tokens"] + r["rest"]
        assert wanted <= got[r["domain"], r["lang"], r["source"]] <= wanted + 300 + (r["rest"] == 0) * 0
    assert mixture.stage(spark, docs_of([]), "").collect() == []


def test_shortages_go_to_siblings_first(spark):
    rows = [(i, "x" * 400, "en", "small") for i in range(2)] + [(100 + i, "x" * 400, "en", "big") for i in range(98)]
    rows += [(300 + i, "x" * 400, "de", "big") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    m = mixture.Mixture(budget_share=0.5, epochs=1, domains=1, lang_weights=())
    got = {(r["lang"], r["source"]): r["full"] * r["tokens"] + r["rest"] for r in mixture.leaf_budgets(docs, m).collect()}
    assert got == {("en", "small"): 200, ("en", "big"): 4800, ("de", "big"): 5000}


def slow_license(text):
    best, matches = None, 0
    lines = [x for x in (text or "").split("\n") if licenses.re.search(r"[^\W_]", x)]
    for unit in [*lines, *(["\n".join(lines)] if len(lines) > 1 else [])]:
        b, found = Counter(w.rsplit(" ", 1)[0] for w in licenses.bigrams(unit)), []
        for name, template in licenses.TEMPLATES.items():
            t = Counter(w.rsplit(" ", 1)[0] for w in licenses.bigrams(template))
            dice = 2 * (b & t).total() / max(1, b.total() + t.total())
            if dice >= licenses.LEAST:
                found.append((-dice, name))
        if found:
            matches += 1
            best = min(found + ([best] if best else []))
    return (best[1], round(-best[0], 6), matches) if best else (None, None, matches)


def test_licenses(spark, docs_of):
    texts = [*licenses.TEMPLATES.values(), "x\nlicensed under the  APACHE license - version 2.0\ny", "Licensed under", None, "All rights\nreserved.",
             "all rights all rights all rights reserved", "Licensed under the Apache License,\nVersion 2.0.",
             "", "Rights reserved all.", "All rights reserved.\nAll rights reserved.\nReleased under the MIT License."]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]
    got = licenses.scan(docs_of(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *slow_license(t)) for i, t in rows), key=str)
    named = {r["doc_id"]: r["license"] for r in got}
    assert [named[i] for i in range(len(licenses.TEMPLATES))] == list(licenses.TEMPLATES)
    assert licenses.scan(docs_of([])).collect() == []


def test_licenses_of_the_table(spark):
    docs = read(spark, LARGER, "documents")
    got = licenses.scan(docs).collect()
    wanted = [(r["doc_id"], *slow_license(r["text"])) for r in docs.collect()]
    assert sorted((tuple(r) for r in got), key=str) == sorted(wanted, key=str)
    assert sum(r["license"] is not None for r in got) > 10
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def slow_windows(text):
    lines = [" ".join(licenses.re.findall(r"[^\W_]+", x.lower())) for x in (text or "").split("\n")]
    lines = [x for x in lines if x]
    name, score, matches = slow_license(text)
    if len(lines) > 1 and slow_license(" ".join(lines))[0]:
        return name, score, matches
    words = " ".join("\n" if slow_license(x)[0] else x for x in lines).split(" ")
    best, spans = [(-score, name)] if name else [], []
    for key, template in licenses.TEMPLATES.items():
        t = Counter(w.rsplit(" ", 1)[0] for w in licenses.bigrams(template))
        n = t.total()
        for at in range(len(words) - n):
            b = Counter(f"{x} {y}" for x, y in zip(words[at : at + n], words[at + 1 : at + n + 1]))
            if (b & t).total() / n >= licenses.LEAST:
                best.append((-(b & t).total() / n, key))
                spans.append((at, at + n + 1))
    end = 0
    for a, b in sorted(spans):
        matches, end = matches + (a >= end), max(end, b)
    return (min(best)[1], round(-min(best)[0], 6), matches) if best else (None, None, matches)


def test_licenses_among_other_words(spark, docs_of):
    gpl = "This work is licensed under the GNU\nGeneral Public License, version 3."
    texts = ["Copyright 2024 Acme Inc. All rights reserved.", "Some sentence before it. Released under the MIT License.",
             f"One line.\nAnother line about nothing.\n{gpl}\nAnd more of it.", f"// {gpl}".replace("\n", "\n// ") + "\n" + "x y z\n" * 20,
             "Released under the MIT License.\nFoo bar. All rights\nreserved. Baz.", "we all have rights and reserved seats for the mit team",
             "all rights reserved " * 3, "The license version 2 0 licensed under the Apache License version 2.0 and so on and on and on", None, ""]
    got = licenses.scan_all(docs_of(list(enumerate(texts)))).collect()
    named = {r["doc_id"]: r["license"] for r in got}
    assert [named[i] for i in range(6)] == ["all-rights", "mit", "gpl-3", "gpl-3", "all-rights", None]
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *slow_windows(t)) for i, t in enumerate(texts)), key=str)


def test_query_licenses_of_the_table(spark):
    docs = read(spark, SMALL, "documents")
    frame = licenses.op6_licenses(spark, SMALL)
    wanted = [(r["doc_id"], *slow_windows(r["text"])) for r in docs.collect()]
    assert sorted((tuple(r) for r in frame.collect()), key=str) == sorted(wanted, key=str)
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_pipeline(spark):
    import corpus_pipeline
    from panelloom.llm import toxicity

    docs = read(spark, SMALL, "documents")
    named = [name for name, _ in corpus_pipeline.STAGES]
    assert named == ["toxicity", "exact dedup", "simhash near-dedup", "mixture", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).cache()
        if name != "bpe":
            assert out.columns == docs.columns
            assert out.join(docs, docs.columns, "left_anti").count() == 0
        docs, before = out, docs
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in docs.collect()}
    assert docs.count() == before.count()
    ids = {r["doc_id"] for r in toxicity.op8_toxicity(spark, SMALL).where("predicted = 1").collect()}
    assert not ids & {r["doc_id"] for r in docs.collect()}
    texts = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in before.collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in docs.collect()} == texts


def test_mixture_stage_takes_any_extra_column(spark, docs_of):
    """Names the operator uses inside, in either case, and one that needs quoting."""
    names = ["_full", "_docs", "_taken", "_epoch", "_domain", "_lang", "_source", "_last", "_LEAF", "_leaf_", "docs", "tokens",
             "full", "rest", "last", "domain", "place", "part", "budget", "supply"]
    docs = docs_of(ODD, extra=False).withColumns({n: F.lit(i) for i, n in enumerate(names)})
    kept = mixture.stage(spark, docs, "")
    assert kept.columns == docs.columns
    plain = mixture.stage(spark, docs_of(ODD, extra=False), "")
    assert sorted(map(str, kept.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert all(r[n] == i for r in kept.collect() for i, n in enumerate(names))
    assert mixture.stage(spark, docs.limit(0), "").collect() == []
