"""Encoding by chunks against the tokenizers library."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelloom.llm import bpe
from panelloom.llm.common import read
from tests.llm.conftest import LARGER, ODD


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def expected(library, rows):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


def test_odd_rows_and_shared_passages(docs_of, library):
    rng = np.random.default_rng(3)
    words = ["the", "naïve", "don't", "12,345", "  ", "\n\n", "ßtraße", "🙂🙂", "x" * 40, "end.", "I'll", " ", "'re"]
    say = lambda n: " ".join(rng.choice(words, n))
    passage = say(900)
    rows = ODD + [(100 + i, say(200) + passage[i * 3 :] + say(100)) for i in range(12)]
    rows += [(200 + i, "".join(rng.choice(words, 1500))) for i in range(4)] * 2
    got = bpe.encode_documents(docs_of(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(library, rows)


def test_table(spark, library):
    docs = read(spark, LARGER, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = bpe.encode_documents(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(library, rows)


def test_nothing(docs_of):
    assert bpe.encode_documents(docs_of([])).collect() == []


def test_shared_passages_become_shared_chunks():
    rng = np.random.default_rng(2)
    passage = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))
    one, two = (set(bpe.chunks(bytes(rng.integers(97, 123, n, dtype=np.uint8)) + passage)) for n in (777, 3_001))
    assert sum(map(len, one & two)) > 0.7 * len(passage)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab1 '\n\t.!é日 　sre", max_size=12), min_size=2, max_size=5))
def test_joins_are_repaired_exactly(parts):
    tool = bpe.codec()
    ids: list[int] = []
    for part in parts:
        ids = tool.join(ids, tool.plain(part))
    assert ids == tool.plain("".join(parts))
    assert tool.joined([tool.plain(p) for p in parts]) == ids


def test_long_texts_without_blanks_are_joined_in_one_go(monkeypatch):
    """Every byte is encoded again once at most, however many chunks have no place to split."""
    rng = np.random.default_rng(5)
    tool = bpe.codec()
    signs = "".join(map(chr, rng.integers(0x4E00, 0x9000, 400_000)))
    text = f"{signs} and so on. {signs[:1000]}"
    pieces = bpe.chunks(text.encode())
    assert len(pieces) > 300
    parts = [tool.plain(p.decode()) for p in pieces]
    want, again, plain = tool.plain(text), [], tool.plain
    monkeypatch.setattr(tool, "plain", lambda t: again.append(len(t)) or plain(t))
    assert tool.joined(parts) == want
    assert sum(again) <= len(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é日\n", max_size=200).map(lambda t: t * 40))
def test_chunks_join_to_the_text(text):
    data = text.encode()
    pieces = bpe.chunks(data)
    assert b"".join(pieces) == data
    assert all(len(p) <= bpe.MOST and p.decode() is not None for p in pieces)
