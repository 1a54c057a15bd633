"""Grouping exports, against the rules applied to all pairs one by one."""

from __future__ import annotations

import difflib
import random
import re

import pytest

from helpers import raw, row, units_table
from threadlake.operators import ranking, stitch

PLACEHOLDER = re.compile(r"^(?:_chat|unknown chat|group \(\d+ participants\)|.+ / .+)$", re.I)


def grouped(spark, titles, rows, mode="full"):
    out = stitch.stitch(units_table(spark, titles), raw(spark, rows), mode).unit_chat
    return {r.unit_idx: r.chat_id for r in out.collect()}


def by_hand(titles, rows, close=0.92, share=0.15):
    """Every pair of exports, one at a time."""
    n = len(titles)
    people = [frozenset(r[3].casefold() for r in rows if r[0] == u and r[3]) for u in range(n)]
    keys = [{(r[2].replace(second=0), r[3], r[4]) for r in rows if r[0] == u} for u in range(n)]
    group = [
        len(people[u]) > 2 or any(r[0] == u and r[5] == "system" and "created group" in r[4] for r in rows)
        for u in range(n)
    ]
    norm = [" ".join(t.split()).casefold() for t in titles]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            same = norm[i] == norm[j] and norm[i] and not PLACEHOLDER.match(titles[i])
            near = (
                not same and norm[i] and norm[j]
                and difflib.SequenceMatcher(None, norm[i], norm[j]).ratio() > close
            )
            alike = bool(people[i]) and people[i] == people[j]
            small = min(len(keys[i]), len(keys[j]))
            common = len(keys[i] & keys[j]) / small if small else 0.0
            direct = alike and not group[i] and not group[j]
            if same or direct or ((near or alike) and common >= share):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(n)}


SHARED = [((10, 8, 0), "Ana", "update?"), ((10, 8, 1), "Me", "soon"), ((10, 8, 2), "Ana", "ok")]


def test_two_exports_of_one_chat(spark):
    rows = [row(u, i, *m) for u in (0, 1) for i, m in enumerate(SHARED)]
    assert grouped(spark, ["Ana", "ANA "], rows) == {0: 0, 1: 0}
    assert grouped(spark, ["Ana", "An"], rows, "titles") == {0: 0, 1: 1}
    assert grouped(spark, ["Ana", "An"], rows) == {0: 0, 1: 0}


def test_unrelated_chats_stay_apart(spark):
    rows = [row(0, 0, (10, 8, 0), "Ana", "hi"), row(0, 1, (10, 8, 1), "Me", "hi")]
    rows += [row(1, 0, (10, 8, 0), "Eva", "hi"), row(1, 1, (10, 8, 1), "Me", "hi")]
    assert grouped(spark, ["Ana", "Eva"], rows) == {0: 0, 1: 1}


def test_equal_placeholder_titles_need_common_messages(spark):
    rows = [row(0, 0, (10, 8, 0), "A", "x"), row(1, 0, (10, 8, 0), "A", "x"), row(1, 1, (10, 9, 0), "B", "y")]
    rows += [row(2, 0, (11, 8, 0), "C", "z")]
    assert grouped(spark, ["_chat", "_chat", "_chat"], rows) == {0: 0, 1: 0, 2: 2}


def test_threshold_is_inclusive(spark):
    def exports(common):
        rows = []
        for u in (0, 1):
            rows += [row(u, 100 + i, (10, 8, i), "ABC"[i % 3], "shared") for i in range(common)]
            rows += [row(u, i, (11 + u, 9, i), "ABC"[i % 3], "own") for i in range(20 - common)]
        return rows

    assert grouped(spark, ["Trip", "Holiday"], exports(3)) == {0: 0, 1: 0}
    assert grouped(spark, ["Trip", "Holiday"], exports(2)) == {0: 0, 1: 1}


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        stitch.stitch(units_table(spark, ["a"]), raw(spark, []), "magic")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_exports_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    rosters = ["Ana Me", "Ana Me Eva", "Me Eva", "Cem Dia Eli", "Cem Dia Eli Me"]
    stems = ["Weekend Planning Group 1", "Weekend-Planning Group 1", "Weekend Planning Group 77", "_chat", "Ana"]
    titles, rows = [], []
    for u in range(36):
        titles.append(rng.choice(stems) if rng.random() < 0.5 else f"solo title number {u} {rng.random()}")
        roster = rng.choice(rosters).split()
        size = rng.choice([1, 2, 5, 9, 20, 30])
        start = rng.randrange(60)
        for i in range(size):
            slot = start + i if rng.random() < 0.8 else 500 + rng.randrange(400)
            # What is said in a slot is fixed, so exports that cover it share it.
            rows.append(row(u, i, (1 + slot // 60, 8, slot % 60), roster[slot % len(roster)], f"m{slot % 7}"))
    assert grouped(spark, titles, rows) == by_hand(titles, rows)


def test_many_holders_of_one_message(spark):
    """A message in every export of equal people: a chain of partial re-exports."""
    rows, titles = [], []
    for u in range(30):
        titles.append(f"copy {u} {chr(97 + u % 26) * 12}")
        rows.append(row(u, 0, (1, 1, 1), "Ana", "pinned"))
        rows += [row(u, 1 + i, (2, 8 + (u * 7 + i) // 60, (u * 7 + i) % 60), "BCD"[i % 3], "t") for i in range(12)]
    assert grouped(spark, titles, rows) == by_hand(titles, rows)


def test_common_message_alone_joins_nobody(spark):
    rows, titles = [], []
    for u in range(12):
        titles.append(f"own name {chr(97 + u) * 9}")
        rows.append(row(u, 0, (1, 1, 1), "Ana", "pinned"))
        rows += [row(u, 1 + i, (2 + u, 8, i), "BCD"[i % 3], f"t{u}") for i in range(10)]
    assert grouped(spark, titles, rows) == {u: u for u in range(12)}


def test_small_buckets_give_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 4)
    test_many_holders_of_one_message(spark)


def test_overlap_of_pairs(spark):
    rows = [row(0, 0, (10, 8, 0), "A", "x"), row(0, 1, (10, 8, 1), "A", "y"), row(1, 0, (10, 8, 0), "A", "x")]
    pairs = spark.createDataFrame([(0, 1), (0, 7)], "a bigint, b bigint")
    got = {(r.a, r.b): (r.shared, r.overlap) for r in stitch.overlap(pairs, stitch.message_keys(raw(spark, rows))).collect()}
    assert got == {(0, 1): (1, 1.0), (0, 7): (0, 0.0)}


def test_close_titles_match_the_ratio(spark):
    names = ["Weekend Planning Group 1", "Weekend-Planning Group 1", "Ahoy", "ahoy!", "Weekend", ""]
    pairs = spark.createDataFrame(
        [(a, b) for a in names for b in names], "title_a string, title_b string"
    )
    got = {(r.title_a, r.title_b) for r in stitch.close_titles(pairs).collect()}
    assert got == {
        (a, b) for a in names for b in names if difflib.SequenceMatcher(None, a, b).ratio() > 0.92
    }


def test_similar_titles_against_all_pairs(spark):
    rng = random.Random(9)
    titles = {"a", "ab", "weekend planning group 1"}
    for _ in range(25):
        base = "".join(rng.choices("abcdefgh ", k=rng.choice((8, 14, 26, 40))))
        titles.add(base)
        for _ in range(4):
            text = list(base)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(text))
                text[at : at + rng.randint(0, 1)] = rng.choice(("", "z", "yx"))
            titles.add("".join(text))
    titles = sorted(titles)
    facts = spark.createDataFrame(list(enumerate(titles)), "unit_idx bigint, norm_title string")
    keys = spark.range(len(titles)).selectExpr("id AS unit_idx", "'everyone' AS key")
    got = {(r.title_a, r.title_b): r.ratio for r in stitch.close_title_pairs(keys, facts).collect()}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    want = {(a, b): ratio(a, b) for a in titles for b in titles if a and a < b and ratio(a, b) > 0.92}
    assert got == want and want


def test_a_template_of_titles_makes_no_pairs(spark):
    """20,000 titles that differ in a number, each with a neighbour's message and one of all."""
    n = 20_000
    facts = spark.range(n).selectExpr("id AS unit_idx", "concat('weekend planning group ', id) AS norm_title")
    keys = spark.range(n).selectExpr("id AS unit_idx", "explode(array(id div 2, -1 - id)) AS key")
    assert stitch.close_title_pairs(keys, facts).count() == n // 2
    units = facts.selectExpr("unit_idx", "unit_idx AS source_idx", "'x.zip' AS label", "norm_title AS title")
    # Ten messages of its own, and the notice is too little in common.
    messages = spark.range(n).selectExpr(
        "id AS unit_idx", "explode(sequence(0, 10)) AS msg_no", "TIMESTAMP_NTZ'2026-03-10 08:00:00' AS ts"
    )
    rows = messages.selectExpr(
        "unit_idx", "CAST(msg_no AS BIGINT) AS msg_no", "ts",
        "CASE WHEN msg_no > 0 THEN concat('P', unit_idx, ' ', msg_no % 3) END AS sender",
        "CASE WHEN msg_no > 0 THEN concat('text ', unit_idx, ' ', msg_no) ELSE 'a notice for everyone' END AS text",
        "CASE WHEN msg_no > 0 THEN 'text' ELSE 'system' END AS kind",
    )
    empty = raw(spark, []).select("attachment", "edited", "has_seconds")
    rows = rows.selectExpr("*", f"CAST(NULL AS {empty.schema['attachment'].dataType.simpleString()}) AS attachment",
                           "false AS edited", "false AS has_seconds")
    chats = stitch.stitch(units, rows.select(*raw(spark, []).columns)).unit_chat
    assert chats.select("chat_id").distinct().count() == n


def test_a_notice_of_all_makes_no_pairs(spark):
    """Exports of other people and titles that share one message are never put together."""
    rows = []
    for unit in range(60):
        rows.append(row(unit, 0, (10, 8, 0), None, "a notice for everyone"))
        rows.append(row(unit, 1, (10, 9, 0), f"P{unit}", f"text {unit}"))
    titles = [f"{unit:03d}" * 4 for unit in range(60)]
    profiles = stitch.unit_profiles(units_table(spark, titles), raw(spark, rows))
    holders = stitch._rarest_first(stitch.message_keys(raw(spark, rows)))
    lines = stitch._alike(holders, profiles.select("unit_idx", "people_key", "norm_title"))
    assert holders.count() == 60 and lines.agg({"pos": "max"}).first()[0] == 0
    assert len(set(grouped(spark, titles, rows).values())) == 60
