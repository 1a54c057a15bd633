from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from threadlake.llm.token_counts import token_counts
from threadlake.llm.token_fst import CHUNK, BytePairs, TokenCounter

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_documents(spark, documents, library):
    rows = token_counts(documents, PATH).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    want = dict(zip(texts, expected(library, list(texts.values()))))
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.n_bytes) == (want[r.doc_id], len(texts[r.doc_id].encode()))
        assert r.over_limit == (r.n_tokens > 1024)


def test_edge_rows(spark, edge_documents, library):
    got = token_counts(edge_documents, PATH).collect()
    rows = edge_documents.collect()
    counts = expected(library, [r.text or "" for r in rows])
    want = [(r.doc_id, len((r.text or "").encode()), c, c > 1024) for r, c in zip(rows, counts)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(edge_documents.limit(0), PATH).count() == 0


def test_random_strings(counter, library):
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'r", "r", "e", "l", "the", "Z", "12", "!", "...", "é",
             "<|endoftext|>", " ", " ", "日本", "'ve", "<|", "\x00", "\U0001f600"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 15))) for _ in range(3000)]
    assert counter.count(texts).tolist() == expected(library, texts)


@pytest.mark.parametrize("size", [CHUNK - 1, CHUNK, CHUNK + 1, 5 * CHUNK])
def test_chunk_borders(counter, library, size):
    """Every kind of state can cross from a chunk to the next."""
    texts = [c * (size - k) + tail for c in " a1!\n'" for k in (0, 1, 2) for tail in ("'re", "'r x", " y", "\n z", "", "'ll")]
    assert counter.count(["".join(texts)]).tolist() == expected(library, ["".join(texts)])
    assert counter.count(texts).tolist() == expected(library, texts)


def test_long_pretokens(counter, library):
    rng = random.Random(6)
    texts = ["ab" * 20000, " " * 30000, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(20000))]
    assert counter.count(texts).tolist() == expected(library, texts)


def test_room_runs_out(monkeypatch, library):
    """With few states the rest is counted without keeping any."""
    import threadlake.llm.token_fst as module

    monkeypatch.setattr(module, "MAX_STATES", 40)
    texts = ["A sentence with several different words, and then some.", "zzz" * 50, "été"] * 3
    assert TokenCounter(PATH).count(texts).tolist() == expected(library, texts)


def test_sound_tokens(counter, library):
    """The pairs that merging allows are found from the ranks alone."""
    pairs: BytePairs = counter._pairs
    tokens = sorted(t for t in library.get_vocab() if t != "<|endoftext|>")[::97]
    decode = library.decoder.decode
    for token in tokens:
        text = decode([token])
        if "�" not in text:
            data = np.frombuffer(text.encode(), np.uint8)
            got = pairs.counts(data, np.array([0]), np.array([len(data)]))[0]
            assert got == pairs._slow(data.tobytes())
