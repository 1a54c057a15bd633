"""Positions and components, with buckets small enough to have edges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from threadlake.operators import components, ranking


@pytest.fixture()
def small_buckets(monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 4)


def numbers(spark, n, groups=3):
    rng = random.Random(1)
    rows = [(rng.choices(range(groups), weights=[8, 1, 1])[0], i, rng.randrange(100)) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g bigint, at bigint, v bigint")


@pytest.mark.parametrize("settle", [False, True])
def test_bucketed_index(spark, settle):
    rows, df = numbers(spark, 200)
    out = ranking.bucketed_index(
        df, ["g"], F.floor(F.col("v") / 7).cast("bigint"), ["v", "at"], "idx", settle=settle
    )
    assert out.columns == ["g", "at", "v", "idx"]
    expected = {}
    for g in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))
        expected.update({r: i for i, r in enumerate(members)})
    assert {(r.g, r.at, r.v): r.idx for r in out.collect()} == expected


def test_dense_index_and_totals(spark, small_buckets):
    rows, df = numbers(spark, 100)
    placed = ranking.dense_index(df, ["g"], "at", "idx", start=1)
    total = ranking.running_total(placed, ["g"], "idx", F.col("v"), "sum")
    got = {(r.g, r.at): (r.idx, r.sum) for r in total.collect()}
    for g in {r[0] for r in rows}:
        run = 0
        for i, r in enumerate(sorted(r for r in rows if r[0] == g), start=1):
            run += r[2]
            assert got[(g, r[1])] == (i, run)


def test_previous_row_across_buckets(spark, small_buckets):
    df = spark.range(23).select(F.lit(0).alias("g"), F.col("id").alias("at"), (F.col("id") * 10).alias("v"))
    got = {r.at: r.prev_v for r in ranking.with_previous(df, ["g"], "at", ["v"]).collect()}
    assert got == {i: (i - 1) * 10 if i else None for i in range(23)}


def test_global_index(spark):
    rows, df = numbers(spark, 300)
    got = ranking.global_index(df.repartition(9), [F.desc("v"), "at"], "n").collect()
    ordered = sorted(rows, key=lambda r: (-r[2], r[1]))
    assert {(r.g, r.at, r.v): r.n for r in got} == {r: i for i, r in enumerate(ordered)}


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)],
        "path": [(i, i + 1) for i in range(40)],
        "star": [(50, i) for i in range(40)],
        "none": [(1, 1)],
    }[shape]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    df = spark.createDataFrame(edges, "x bigint, y bigint")
    got = {r.node: r.root for r in components.star_components(df, "x", "y").collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
