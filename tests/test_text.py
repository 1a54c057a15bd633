"""Scalar functions against plain Python on awkward strings."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from threadlake.functions import display as D
from threadlake.functions import fuzzy
from threadlake.functions import patterns as p
from threadlake.functions import text as X

AWKWARD = [
    "", " ", "Straße STRASSE", "ΣΊΣΥΦΟΣ σίσυφος", "Yıldız Yildiz", "İstanbul", "ﬁne", "a​b­c",
    "﻿ x ⁦y⁩", "tab\tnew\nline\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0     　end",
    "  both  ends  ", "naïve Ñandú ÅNGSTRÖM", "각 가", "emoji \U0001f600 x", "é É",
]
INVISIBLE = re.compile("[​-‏⁦-⁩﻿­]")


def values(spark, expression, rows=AWKWARD):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[1] for r in frame.select("i", expression(F.col("t"))).orderBy("i").collect()]


def test_equality_of_normal_forms_is_that_of_casefolding(spark):
    rows = AWKWARD + [s.upper() for s in AWKWARD] + [s.lower() for s in AWKWARD]
    got = values(spark, X.normalize_text, rows)
    want = [re.sub(r"\s+", " ", INVISIBLE.sub("", s)).strip().casefold() for s in rows]
    for i in range(len(rows)):
        for j in range(i):
            assert (got[i] == got[j]) == (want[i] == want[j]), (rows[i], rows[j])


def test_strips_like_python(spark):
    rows = [a + "x" + a for a in AWKWARD if not a.strip()] + AWKWARD
    assert values(spark, X.strip, rows) == [r.strip() for r in rows]
    assert values(spark, X.strip_right, rows) == [r.rstrip() for r in rows]
    assert values(spark, X.collapse_whitespace, rows) == [re.sub(r"\s+", " ", r) for r in rows]


def test_media_names(spark):
    rows = ["00000019-PHOTO-1.JPG", "x/y/0000012-a.png", "12345-a.png", "12345678901-a"]
    assert values(spark, X.media_identity, rows) == ["photo-1.jpg", "a.png", "12345-a.png", "12345678901-a"]
    rows = ["a.JPG", "b.m4a", "AUDIO-1.m4a", "x-PTT-2.wav", "PTT.wav", "noext", "x.unknown", "c.vcf"]
    assert values(spark, X.attachment_kind, rows) == [
        "image", "audio", "voice", "voice", "audio", "document", "document", "contact",
    ]
    assert values(spark, X.attachment_mime, ["a.webm", "z"]) == ["video/webm", "application/octet-stream"]


def test_titles(spark):
    rows = {
        "WhatsApp Chat with Ana Lima.zip": "Ana Lima",
        "WhatsApp Chat with Ana Lima (2).zip": "Ana Lima",
        "WhatsApp Chat - Ana.zip": "Ana",
        "Conversa do WhatsApp com Rui7.txt": "Rui7",
        "whatsapp_chat_Ana_Lima_2026-03-12.txt": "Ana Lima",
        "Dr. Who.zip": "Dr. Who",
        "_chat.txt": "chat",
        " - .txt": "Unknown chat",
    }
    assert values(spark, X.clean_title, list(rows)) == list(rows.values())


def test_placeholder_titles(spark):
    rows = ["_chat", "Unknown Chat", "Group (12 participants)", "A / B", "Group (x participants)", "A/B", "_chats"]
    assert values(spark, X.is_placeholder_title, rows) == [True, True, True, True, False, False, False]


def test_kind_codes_round_trip(spark):
    assert values(spark, lambda c: X.kind_name(X.kind_code(c)), list(p.MESSAGE_KINDS)) == list(p.MESSAGE_KINDS)
    assert values(spark, X.kind_code, ["odd"]) == ["t"]


def test_digest_reads_the_whole_file(spark):
    big = bytes(1 << 20)
    frame = spark.createDataFrame([(big,), (big + b"x",), (big + b"y",), (big,)], "c binary")
    got = [r[0] for r in frame.select(X.content_digest(F.col("c"))).collect()]
    assert got[0] == got[3] and len(set(got)) == 3 and len(got[0]) == 64


def test_similarity_does_not_hang_on_the_length(spark):
    """One changed character at each end, below and above the length at which a junk heuristic sets in."""
    rows = [("a" + "xy" * n + "b", "c" + "xy" * n + "d") for n in (20, 120)] + [("abcd", "bcde"), ("abc", "xyz")]
    frame = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in frame.select(fuzzy.similarity("a", "b")).collect()]
    assert [round(g, 9) for g in got] == [round(40 / 42, 9), round(240 / 242, 9), 0.75, 0.0]


def test_dotted_capital_keeps_its_place(spark):
    assert values(spark, fuzzy.align_fold, ["\u0130\u0130x"]) == ["iix"]


def test_folding_forms_agree(spark):
    needles = ["istanbul", "naive", "é", "fine", "x"]
    assert all(fuzzy.folds_natively(n) for n in needles)
    assert not fuzzy.folds_natively("가")
    for needle in [*needles, "가"]:
        want = [fuzzy.fold_text(needle) in fuzzy.fold_text(t) for t in AWKWARD]
        assert values(spark, lambda c: F.contains(fuzzy.fold(c, needle), F.lit(fuzzy.fold_text(needle)))) == want


def markup_free(text):
    """The markup rules, one step at a time, on a plain string."""
    stash = []

    def keep(value):
        stash.append(value)
        return f"\x00{len(stash) - 1}\x00"

    def code(m):
        return keep(m[1].removeprefix("\n") if m[1] is not None else m[2])

    text = re.sub(r"```([\s\S]*?)```|`([^`\n]+)`", code, text)
    parts = re.split(r"((?:https?://|www\.)[^\s<>\"']+[^\s<>\"'.,;:!?)\]}])", text)
    for i in range(0, len(parts), 2):
        for mark in r"\*", "_", "~":
            parts[i] = re.sub(
                rf"(^|[\s(\[]){mark}(\S(?:[^{mark}\n]*\S)?){mark}(?=\Z|[\s.,!?;:)\]])", r"\1\2", parts[i]
            )
    text = "".join(parts)
    return re.sub(r"\x00(\d+)\x00", lambda m: stash[int(m[1])], text)


def test_plain_text(spark):
    rows = [
        "*bold*", "a *b* _c_ ~d~ e", "*b*x", "x*b*", "(*b*), _i_.", "*two words*", "* no *", "*a\nb*", "**a**",
        "*_both_*", "_*both*_", "~*x*~", "`*c*` and *b*", "*see `x y` now*", "```\nkeep *this*\n``` *b*",
        "https://a.b/_x_y_ _i_", "*see https://a.b/c*", "_a_ _b_ _c_", "*a* *b*", "snake_case_name", "2*3*4", "",
        "***", "%%% a*** b###", "*a `b*", "``` `", "*x*<b", "_a_https://x.y/z", "plain",
        "x\ue000y\ue001*b*\ue002 \ue003*c*", "*\ue004a\ue000* `\ue001*k*` \ue004", "\ue000", "https://a.b/\ue000_x_\ue003y *b*",
    ]
    assert values(spark, D.plain_text, rows) == [markup_free(r) for r in rows]


def test_plain_text_of_a_very_long_body(spark):
    body = "*" + "word " * 200_000 + "end*"
    assert values(spark, D.plain_text, [body]) == [body[1:-1]]


def test_links(spark):
    rows = ["see (https://a.b/c), www.x.org/y! http://", "none", "HTTP://A.B https://ü.de/ä?q=1&r=[2]."]
    assert values(spark, D.links, rows) == [
        ["https://a.b/c", "https://www.x.org/y"], [], ["https://ü.de/ä?q=1&r=[2"],
    ]


def test_jumbo(spark):
    rows = ["\U0001f389", " \U0001f64f\U0001f3fd ", "❤️", "\U0001f44d" * 12, "\U0001f44d" * 13, "ok \U0001f389", "42", "", "\U0001f1e7\U0001f1f7"]
    assert values(spark, D.is_jumbo, rows) == [True, True, True, True, False, False, True, False, True]


def test_sizes_and_percentages(spark):
    frame = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (5 << 20,), (3 << 30,), (5 << 40,)], "n bigint")
    assert [r[0] for r in frame.select(D.human_bytes(F.col("n"))).collect()] == [
        "0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB", "3.0 GB", "5120.0 GB",
    ]
    frame = spark.createDataFrame([(1, 8), (3, 8), (0, 0)], "a bigint, b bigint")
    assert [r[0] for r in frame.select(D.percent(F.col("a"), F.col("b"))).collect()] == [13, 38, 0]


def test_sizes_round_ties_to_even(spark):
    sizes = [1_036_544, 1024 + 256, 1024 + 768, 191_102_976, (1 << 20) - 1, (3 << 30) + (1 << 28), (1 << 50) + (3 << 28), None]
    frame = spark.createDataFrame([(n,) for n in sizes], "n bigint")
    assert [r[0] for r in frame.select(D.human_bytes(F.col("n"))).collect()] == [
        "1012.2 KB", "1.2 KB", "1.8 KB", "182.2 MB", "1024.0 KB", "3.2 GB", "1048576.8 GB", None,
    ]


@pytest.mark.parametrize(
    "when, label, stamp",
    [
        ((2026, 1, 6, 23, 0), "Today", "23:00"),
        ((2026, 1, 5, 0, 0), "Yesterday", "Yesterday"),
        ((2026, 1, 4, 9, 0), "Sunday", "Sunday"),
        ((2025, 12, 30, 12, 0, 1), "Tuesday", "Tuesday"),
        ((2025, 12, 30, 12, 0), "30/12/2025", "30/12/2025"),
        ((2026, 2, 1, 0, 0), "01/02/2026", "01/02/2026"),
    ],
)
def test_day_labels(spark, when, label, stamp):
    now = dt.datetime(2026, 1, 6, 12, 0)
    frame = spark.createDataFrame([(dt.datetime(*when),)], "ts timestamp_ntz")
    got = frame.select(D.day_label(F.col("ts"), now), D.list_stamp(F.col("ts"), now)).first()
    assert tuple(got) == (label, stamp)
