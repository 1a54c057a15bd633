from __future__ import annotations

import random
import re

import xxhash

from threadlake.llm.simhash import MAX_BITS, fingerprint, near_dedup_query, near_pairs


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(rows):
    prints = [(d, slow_fingerprint(t)) for d, t in rows]
    group = list(range(len(rows)))
    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= MAX_BITS and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    lowest = {g: min((d for (d, _), h in zip(prints, group) if h == g and d is not None), default=None) for g in group}
    return sorted([(d, f"{p:016x}", lowest[g]) for (d, p), g in zip(prints, group)], key=str)


def test_fingerprints():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 40_000):
        text = " ".join(rng.choice(("Ab", "É", "x y", "#")) + str(rng.randint(0, 9)) for _ in range(n))
        assert fingerprint(text) == slow_fingerprint(text)
    assert fingerprint(None) == fingerprint(" \n\x0b") == 0


def test_pairs_against_brute_force(spark):
    rng = random.Random(2)
    prints = {0, (1 << 64) - 1, 1, 1 << 63}
    for _ in range(60):
        centre = rng.getrandbits(64)
        prints.add(centre)
        for _ in range(12):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    got = {frozenset((r.a, r.b)) for r in near_pairs(frame).collect()}
    ordered = sorted(prints)
    want = {
        frozenset((signed(a), signed(b)))
        for i, a in enumerate(ordered)
        for b in ordered[:i]
        if (a ^ b).bit_count() <= MAX_BITS
    }
    assert got == want and want


def test_edge_rows(spark, edge_documents):
    rows = [(r.doc_id, r.text) for r in edge_documents.collect()]
    got = sorted(map(tuple, near_dedup_query(spark, edge_documents).collect()), key=str)
    assert got == slow_components(rows)
    assert near_dedup_query(spark, edge_documents.limit(0)).count() == 0


def test_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**9)}" for _ in range(900)]
    rows = [(100, " ".join(base))]
    for k in range(12):
        copy = list(base)
        for at in rng.sample(range(900), 3):
            copy[at] = f"other{k}"
        rows.append((k + (101 if k % 2 else 50), " ".join(copy)))
    rows += [(900 + k, " ".join(f"v{rng.randint(0, 10**9)}" for _ in range(80))) for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, near_dedup_query(spark, frame).collect()), key=str)
    assert got == slow_components(rows)
    assert len({g for _, _, g in got}) < len(rows)
