from __future__ import annotations

import hashlib
import random
import statistics

import pytest

from threadlake.llm.piecewise_hash import PIECES, edit_distance, fingerprint, likeness
from threadlake.llm.text_fingerprints import edited, fingerprint_query, fingerprints

WINDOW, MASK = 7, (1 << 64) - 1


def plain_fingerprint(text):
    """The definition byte by byte."""

    def mixed(value):
        value ^= value >> 29
        value = value * 0xBF58476D1CE4E5B9 & MASK
        return value ^ value >> 32

    ends = []
    for i in range(len(text) - 1):
        window = text[max(0, i - WINDOW + 1) : i + 1][::-1]
        ends.append(mixed(sum((b + 1) * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, b in enumerate(window)) & MASK))

    def signature(bits):
        pieces, start = [], 0
        for i in [*[k + 1 for k, e in enumerate(ends) if e % (1 << bits) == 0], len(text)]:
            value = sum((b + 1) * pow(0x5851F42D4C957F2D, j, 1 << 64) for j, b in enumerate(text[start:i])) & MASK
            value = (value ^ value >> 31) * 0xBF58476D1CE4E5B9 & MASK
            pieces.append(value >> 52)
            start = i
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        return "".join(letters[p >> 6] + letters[p & 63] for p in pieces)

    bits = 2
    while len(signature(bits)) > 2 * PIECES:
        bits += 1
    return f"{1 << bits}:{signature(bits)}:{signature(bits + 1)}"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def prose(r, words):
    return " ".join("".join(r.choices("abcdeé", k=r.randrange(2, 8))) for _ in range(words))


def test_fingerprint_by_definition():
    r = random.Random(1)
    assert fingerprint(b"") == "4::"
    for size in [1, 2, 3, 10, 60, 200, 500]:
        text = prose(r, size).encode()
        assert fingerprint(text) == plain_fingerprint(text)
    assert fingerprint(bytes(2000)) == plain_fingerprint(bytes(2000))


def test_edit_distance_against_table():
    r = random.Random(2)
    for _ in range(3000):
        a, b = (r.choices("abcd", k=r.randrange(14)) for _ in "ab")
        assert edit_distance(a, b) == plain_distance(a, b)
    a, b = ([str(r.randrange(30)) for _ in range(64)] for _ in "ab")
    assert edit_distance(a, b) == plain_distance(a, b)


def test_likeness_tells_edits_from_other_texts():
    r = random.Random(3)
    near, far = [], []
    for size in [100, 300, 1000, 5000]:
        for _ in range(10):
            text, other = prose(r, size), prose(r, size)
            near.append(likeness(fingerprint(text.encode()), fingerprint(edited(text, other).encode())))
            far.append(likeness(fingerprint(text.encode()), fingerprint(other.encode())))
            words = text.split()
            words[size // 2] = "changed"
            assert likeness(fingerprint(text.encode()), fingerprint(" ".join(words).encode())) > 0.85
    assert min(near) > 0.5 and statistics.mean(near) > 0.65 and max(far) < 0.2
    assert likeness("4::", "4::") == 1.0 and likeness("4::", fingerprint(b"a")) == 0.0
    # A text twice as long has other block sizes; one of them is shared.
    text = prose(r, 2000)
    assert likeness(fingerprint(text.encode()), fingerprint((text + prose(r, 2000)).encode())) > 0.3


def expected(rows):
    rows = sorted(((i is not None, i or 0, hashlib.sha256((t or "").encode()).digest(), t or "") for i, t in rows))
    out = []
    for (has_id, number, _, text), (*_, following) in zip(rows, rows[1:] + rows[:1]):
        size = len(text) // 4
        changed = text[: len(text) - size] + following[:size]
        mark, changed_mark = fingerprint(text.encode()), fingerprint(changed.encode())
        out.append(
            (
                number if has_id else None, len(text), hashlib.sha256(changed.encode()).hexdigest(), mark, changed_mark,
                likeness(mark, changed_mark), likeness(mark, fingerprint(following.encode())),
            )
        )
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 7])
def test_query_against_sorted_list(spark, documents, partitions):
    docs = documents.repartition(partitions)
    rows = fingerprint_query(spark, docs).collect()
    assert sorted(map(tuple, rows), key=str) == expected([(r.doc_id, r.text) for r in documents.collect()])


def test_edges(spark, edge_documents):
    rows = fingerprint_query(spark, edge_documents).collect()
    assert sorted(map(tuple, rows), key=str) == expected([(r.doc_id, r.text) for r in edge_documents.collect()])
    for one in (edge_documents.limit(0), edge_documents.filter("doc_id = 5"), edge_documents.filter("doc_id = 1")):
        assert sorted(map(tuple, fingerprint_query(spark, one).collect()), key=str) == expected([(r.doc_id, r.text) for r in one.collect()])
    plain = fingerprints(edge_documents).collect()
    assert sorted(((r.doc_id, r.fingerprint) for r in plain), key=str) == sorted(((r.doc_id, r.fingerprint) for r in rows), key=str)


def test_a_very_long_text_and_many_repeats(spark):
    text = prose(random.Random(4), 300_000)
    docs = spark.createDataFrame([(1, text), (2, "short")] + [(3, "again and again")] * 500, "doc_id bigint, text string")
    rows = fingerprint_query(spark, docs).collect()
    assert len(rows) == 502
    assert sorted(map(tuple, rows), key=str) == expected([(r.doc_id, r.text) for r in docs.collect()])
