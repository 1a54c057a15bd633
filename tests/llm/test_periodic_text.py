from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from threadlake.llm import periodic_text
from threadlake.llm.lyndon_runs import lyndon_lengths, runs


def all_runs(s, exponent, least):
    """Every maximal stretch of every period, smallest periods only."""
    found = []
    for p in range(1, len(s)):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            length = j + p - i
            if length >= max(least, exponent * p) and not any(
                all(s[k] == s[k + q] for k in range(i, i + length - q)) for q in range(1, p)
            ):
                found.append((i, length, p))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbers(s):
    seen = {}
    return np.array([seen.setdefault(x, len(seen)) for x in s], np.int64)


def sample(r):
    size = r.choice([1, 2, 2, 3, 5])
    s = [r.randrange(size) for _ in range(r.randrange(40))]
    if s and r.random() < 0.6:
        a = r.randrange(len(s))
        p = 1 + r.randrange(len(s) - a)
        s = s[:a] + [s[a + (i - a) % p] for i in range(a, len(s) + r.randrange(20))]
    return s + [r.randrange(size) for _ in range(r.randrange(4))]


def test_lyndon_lengths_against_comparison_of_suffixes():
    r = random.Random(3)
    for _ in range(1500):
        s = sample(r)
        longest = []
        for i in range(len(s)):
            j = i + 1
            while j < len(s) and s[j:] > s[i:]:
                j += 1
            longest.append(j - i)
        assert lyndon_lengths(s) == longest


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 1), (3, 6), (6, 4)])
def test_runs_against_all_periods(exponent, least):
    r = random.Random(exponent)
    for _ in range(800):
        s = sample(r)
        assert runs(numbers(s), exponent, least) == all_runs(s, exponent, least)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words, 4, 6)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda f: (-f[1] / f[2], f[0], f[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def by_text(row):
    return tuple((x is not None, x or 0) for x in row[:1]) + tuple(map(str, row[1:]))


def test_query_against_brute_force(spark, documents):
    # Brute force takes quadratic time, so the longest texts are left to the other tests.
    short = documents.filter("length(text) < 4000 OR text IS NULL")
    rows = periodic_text.periodic_query(spark, short).collect()
    assert len(rows) == short.count() > 100
    assert sorted(map(tuple, rows), key=by_text) == sorted((expected(r.doc_id, r.text) for r in short.collect()), key=by_text)
    assert sum(r.n_runs for r in rows) > 0


def test_edges(spark, edge_documents):
    rows = periodic_text.periodic_query(spark, edge_documents).collect()
    short = [r for r in edge_documents.collect() if r.doc_id != 5]
    assert sorted((tuple(r) for r in rows if r.doc_id != 5), key=by_text) == sorted((expected(r.doc_id, r.text) for r in short), key=by_text)
    (long,) = [r for r in rows if r.doc_id == 5]
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 24_000, 6)
    assert long.collapsed_sha256 == hashlib.sha256("Ein langer Text, der sich wiederholt.".encode()).hexdigest()
    assert periodic_text.periodic_query(spark, edge_documents.limit(0)).collect() == []


def test_ties_and_other_separators(spark):
    text = "x a b a b a b a b y c d c d c d c d z é\x85é é\x85é é\x85é é\x85é é\x85é é\x85é"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id bigint, text string")
    rows = periodic_text.periodic_runs(docs).collect()
    assert len(rows) == 3
    for row in rows:
        assert [tuple(r) for r in row.runs] == [(1, 8, 2), (10, 8, 2), (19, 6, 1)]
        assert tuple(row.best) == (19, 6, 1)
        assert row.collapsed == "x a b y c d z é\x85é"


def test_a_very_long_text(spark):
    text = "one two three " * 100_000 + " ".join(map(str, range(200_000)))
    docs = spark.createDataFrame([(3, text)], "doc_id bigint, text string")
    (row,) = periodic_text.periodic_runs(docs).collect()
    assert [tuple(r) for r in row.runs] == [(0, 300_000, 3)]
    assert row.n_words == 500_000
