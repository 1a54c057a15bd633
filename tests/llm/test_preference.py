from __future__ import annotations

import re

from threadlake.llm.preference import preference_segments, swapped_answers


def brute(chosen, rejected):
    def turns(rows):
        out: dict = {}
        for pair, turn, role, text in rows:
            if pair is not None and turn is not None:
                said = (role or "", text or "")
                here = out.setdefault(pair, {})
                here[turn] = min(here.get(turn, said), said)
        return {p: [said for _, said in sorted(t.items())] for p, t in out.items()}

    a, b = turns(chosen), turns(rejected)
    out = []
    for pair in sorted(a.keys() | b.keys()):
        left, right = a.get(pair, []), b.get(pair, [])
        n = 0
        while n < min(len(left), len(right)) and left[n] == right[n]:
            n += 1
        for part, said in (("prompt", left[:n]), ("chosen", left[n:]), ("rejected", right[n:])):
            at = 0
            for place, (role, text) in enumerate(said):
                head = f"<|im_start|>{role}\n"
                whole = f"{head}{text}<|im_end|>\n"
                trained = part != "prompt" and role == "assistant"
                out.append(
                    (pair, part, place, role, whole, at, at + len(head) if trained else None, len(whole) - len(head) if trained else None)
                )
                at += len(whole)
    return sorted(out, key=str)


CHOSEN = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "good"),
    (2, 10, "user", "same"), (2, 500, "assistant", "same"), (3, 0, None, None), (3, 1, "assistant", ""),
    (4, 0, "user", "alone"), (None, 0, "user", "x"), (5, None, "user", "x"), (6, 0, "user", "b"), (6, 0, "user", "a"),
    (6, 0, "user", "a"), (6, 1, "assistant", "z" * 100_000),
    *[(7, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(700)],
]
REJECTED = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "other"), (2, 0, "user", "same"),
    (2, 1, "assistant", "same"), (3, 5, "", ""), (3, 6, "assistant", "x"), (3, 7, "user", "y"), (6, 0, "user", "a"),
    (8, 0, "assistant", "only here"), *[(7, i, "user" if i % 2 else "assistant", f"t{i}" if i < 600 else "u") for i in range(650)],
]
SCHEMA = "pair_id bigint, turn bigint, role string, text string"


def test_against_brute_force(spark):
    from pyspark.sql import functions as F

    chosen = spark.createDataFrame(CHOSEN, SCHEMA).withColumn("place", F.lit("clash"))
    rejected = spark.createDataFrame(REJECTED, SCHEMA).withColumn("side", F.lit(1))
    got = preference_segments(chosen, rejected)
    assert sorted(map(tuple, got.collect()), key=str) == brute(CHOSEN, REJECTED)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert preference_segments(chosen.limit(0), rejected.limit(0)).count() == 0


def test_swapped_answers(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "assistant", "b"), (1, 1, "user", "w"), (2, 0, "assistant", "c"),
            (4, 0, "user", "n"), (5, 0, "assistant", "m"), (None, 0, "assistant", "x")]
    chosen, rejected = swapped_answers(spark.createDataFrame(rows, SCHEMA.replace("pair_id", "conv_id")))
    assert sorted(map(tuple, chosen.collect())) == [r for r in rows if r[0] is not None]
    # The answers stand in a ring of those that have one: 0, 1, 2, 5.
    assert sorted(map(tuple, rejected.collect())) == [
        (0, 0, "user", "q"), (0, 1, "assistant", "b"), (1, 0, "assistant", "c"), (1, 1, "user", "w"),
        (2, 0, "assistant", "m"), (4, 0, "user", "n"), (5, 0, "assistant", "a"),
    ]


def test_no_conversation_is_lost(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = preference_segments(*swapped_answers(table)).select("pair_id").distinct().collect()
    assert {r.pair_id for r in rows} == {r.conv_id for r in table.select("conv_id").distinct().collect() if r.conv_id is not None}
    one = spark.createDataFrame([(3, 0, "assistant", "only")], SCHEMA.replace("pair_id", "conv_id"))
    assert [(r.part, r.place) for r in preference_segments(*swapped_answers(one)).collect()] == [("prompt", 0)]
