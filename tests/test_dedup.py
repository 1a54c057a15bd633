"""Collapsing copies, pairing placeholders, ordering."""

from __future__ import annotations

import datetime as dt
import random

from helpers import attachment, one_chat, raw, row
from threadlake.operators import dedup


def merged(spark, rows, units=(0, 1)):
    out = dedup.merge_messages(raw(spark, rows), one_chat(spark, units))
    return out.orderBy("chat_id", "msg_idx").collect()


def test_same_message_in_two_exports(spark):
    rows = merged(spark, [row(0, 0, (12, 9, 0), "Ana", "Done"), row(1, 0, (12, 9, 0), "ana", " done​ ")])
    assert len(rows) == 1 and rows[0].sources == [0, 1] and rows[0].text == " done​ "


def test_copy_with_seconds_survives(spark):
    rows = merged(spark, [row(0, 0, (12, 9, 0, 0), "Ana", "Done"), row(1, 0, (12, 9, 0, 43), "Ana", "Done")])
    assert len(rows) == 1 and rows[0].has_seconds and rows[0].ts.second == 43


def test_first_copy_wins_ties(spark):
    rows = merged(spark, [row(1, 0, (12, 9, 0), "ANA", "Done"), row(0, 5, (12, 9, 0), "Ana", "DONE")])
    assert [(r.sender, r.text) for r in rows] == [("Ana", "DONE")]


def test_photo_with_new_number(spark):
    for extra in ({"content_hash": "abc"}, {}):
        a = attachment("00000019-PHOTO.jpg", **extra)
        b = attachment("00000004-PHOTO.jpg", **extra)
        rows = merged(spark, [row(0, 0, (12, 9, 0), "Me", "", a), row(1, 0, (12, 9, 0), "Me", "", b)])
        assert len(rows) == 1


def test_placeholder_gives_way(spark):
    gone = attachment(omitted=True)
    real = attachment("IMG-1.jpg", path="/x/IMG-1.jpg")
    rows = merged(
        spark, [row(0, 0, (12, 9, 0), "Me", "image omitted", gone), row(1, 0, (12, 9, 0), "Me", "", real)]
    )
    assert len(rows) == 1
    assert rows[0].attachment.filename == "IMG-1.jpg" and rows[0].sources == [0, 1]


def test_placeholders_pair_in_order(spark):
    rows = [row(0, i, (12, 9, 0), "Me", f"c{i}", attachment(omitted=True)) for i in range(3)]
    rows += [row(1, i, (12, 9, 0), "Me", "", attachment(f"P{i}.jpg")) for i in range(2)]
    rows += [row(1, 9, (12, 9, 0), "Me", "plain")]
    got = merged(spark, rows)
    assert sorted((r.attachment.filename, r.sources) for r in got if r.attachment) == [
        ("", [0]), ("P0.jpg", [0, 1]), ("P1.jpg", [0, 1]),
    ]


def test_placeholder_of_the_same_export(spark):
    gone, real = attachment(omitted=True), attachment("IMG-1.jpg")
    for other, whole, apart in ((0, 1, 2), (1, 1, 1)):
        rows = [row(0, 0, (12, 9, 0), "Me", "image omitted", gone), row(other, 1, (12, 9, 0), "Me", "", real)]
        frame, chats = raw(spark, rows), one_chat(spark, (0, 1))
        assert dedup.merge_messages(frame, chats).count() == whole
        assert dedup.merge_messages(frame, chats, require_other_source=True).count() == apart


def test_contact_cards_never_pair(spark):
    rows = [
        row(0, 0, (12, 9, 0), "Me", "x", attachment(omitted=True)),
        row(1, 0, (12, 9, 0), "Me", "", attachment("a.vcf", "contact"), kind="contact"),
    ]
    assert len(merged(spark, rows)) == 2


def test_distinct_messages_stay(spark):
    rows = [row(0, 0, (12, 9, 0), "A", "one"), row(0, 1, (12, 9, 0), "A", "two"), row(0, 2, (12, 9, 0), None, "one")]
    assert len(merged(spark, rows)) == 3


def test_order_is_by_time_then_first_occurrence(spark):
    rows = [
        row(0, 0, (12, 9, 0), "A", "z"),
        row(0, 1, (12, 9, 0), "B", "y"),
        row(1, 0, (12, 9, 0), "B", "y"),
        row(1, 1, (12, 8, 59), "C", "early"),
        row(1, 2, (12, 9, 0), "C", "x"),
    ]
    assert [r.text for r in merged(spark, rows)] == ["early", "z", "y", "x"]


def test_merging_is_idempotent_and_ignores_partitioning(spark):
    random.seed(5)
    rows = [
        row(u, i, (1 + random.randrange(3), 9, random.randrange(4)), random.choice("AB"), random.choice("pqr"))
        for u in range(3)
        for i in range(20)
    ]
    chats = one_chat(spark, range(3))
    columns = ["msg_idx", "ts", "sender", "text", "sources"]
    once = dedup.merge_messages(raw(spark, rows), chats).select(columns)
    again = dedup.merge_messages(
        raw(spark, rows).union(raw(spark, rows)).repartition(7), chats
    ).select(columns)
    assert sorted(once.collect()) == sorted(again.collect())


def test_stats(spark):
    out = dedup.merge_messages(
        raw(
            spark,
            [
                row(0, 0, (12, 9, 0), "A", "x"),
                row(1, 0, (12, 9, 0), "A", "x"),
                row(0, 1, (12, 9, 1), "A", "", attachment("a.jpg", path="/a.jpg")),
                row(0, 2, (12, 9, 2), "A", "", attachment("b.jpg")),
            ],
        ),
        one_chat(spark, (0, 1)),
    )
    assert dedup.merge_stats(out).first().asDict() == {
        "chats": 1, "messages": 3, "overlapping": 1, "media": 2, "media_resolved": 1,
    }


def test_minutes_do_not_depend_on_the_time_zone(spark):
    frame = spark.createDataFrame([(dt.datetime(2026, 3, 8, 2, 30, 5),)], "ts timestamp_ntz")
    from threadlake.functions import text as X
    from pyspark.sql import functions as F

    expected = int(dt.datetime(2026, 3, 8, 2, 30, 5, tzinfo=dt.timezone.utc).timestamp())
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = frame.select(X.epoch_seconds(F.col("ts")), X.epoch_minute(F.col("ts"))).first()
            assert tuple(got) == (expected, expected // 60)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
