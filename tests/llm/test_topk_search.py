from __future__ import annotations

import numpy as np
import pytest

from threadlake.llm.topk_search import nra_tile, quantise, top_k


def brute(rows, k, step):
    out = []
    for q, a in rows.items():
        if q % step:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b)), v) for v, b in rows.items() if v != q and len(b) == len(a))
        out += [(q, rank, v, -s) for rank, (s, v) in enumerate(scores[:k], 1)]
    return sorted(out)


def collect(frame):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in frame.collect())


@pytest.mark.parametrize("shard,block", [(4096, 512), (9, 2)])
def test_against_brute_force(spark, shard, block):
    rng = np.random.default_rng(3)
    rows = {int(i): rng.integers(-5, 6, 6).tolist() for i in range(90)}
    frame = spark.createDataFrame([(i, v) for i, v in rows.items()], "vec_id bigint, values array<bigint>")
    assert collect(top_k(frame, 5, 10, shard, block)) == brute(rows, 5, 10)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, -0.5], "a"), (0, [0.5, -0.5], "a"), (1, [0.5, -0.5], "b"), (2, [0.004, 1.0], "c"), (3, None, "d"),
        (4, [None, 1.0], "e"), (5, [nan, 1.0], "f"), (6, [inf, 1.0], "g"), (None, [1.0, 1.0], "h"), (7, [1.0], "i"),
        (10, [-0.5, 0.5], "j"), (8, [], "k"),
    ]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    kept = {r.vec_id: list(r["values"]) for r in quantise(frame).collect()}
    assert kept == {0: [128, -128], 1: [128, -128], 2: [1, 256], 7: [256], 10: [-128, 128], 8: []}
    assert collect(top_k(quantise(frame), 5, 5)) == brute(kept, 5, 5)
    assert top_k(quantise(frame.limit(0))).count() == 0


def test_large_numbers_stay_exact():
    vectors = np.array([[1 << 30, 3], [1 << 30, 4], [-(1 << 30), 9], [1 << 29, 7]])
    ids = np.arange(4)
    q, v, s = nra_tile(ids, vectors, ids, vectors, 2)
    want = {i: sorted(((int(vectors[i] @ vectors[j]), -j) for j in range(4) if j != i), reverse=True)[:2] for i in range(4)}
    got = {i: [(int(c), -int(b)) for a, b, c in zip(q, v, s) if a == i] for i in range(4)}
    assert got == want


def test_equal_vectors():
    vectors = np.ones((200, 3), int)
    q, v, s = nra_tile(np.arange(200), vectors, np.array([0, 150]), vectors[:2], 3)
    assert [(int(a), int(b), int(c)) for a, b, c in zip(q, v, s)] == [
        (0, 1, 3), (0, 2, 3), (0, 3, 3), (150, 0, 3), (150, 1, 3), (150, 2, 3)
    ]
