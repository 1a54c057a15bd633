"""Archives, loose transcripts, folders and encodings, read end to end."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from helpers import MARK
from threadlake import build_archive
from threadlake.sources import exports as S


def pack(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("exports")
    first = (
        f"[10/03/2026, 08:12:04] {MARK}Messages are private.\n[10/03/2026, 08:12:05] Ana Lima: Good morning\n"
        f"[10/03/2026, 08:14:31] Rui: Morning.\n[10/03/2026, 08:15:10] Rui: {MARK}<attached: 00000019-PHOTO-1.jpg>\n"
        "[13/03/2026, 08:16:10] Ana Lima: image omitted\n"
    )
    second = (
        f"[10/03/2026, 08:14:31] Rui: Morning.\n[10/03/2026, 08:15:10] Rui: {MARK}<attached: 00000004-PHOTO-1.jpg>\n"
        f"[13/03/2026, 08:16:12] Ana Lima: {MARK}<attached: 00000005-PHOTO-2.jpg>\n"
        f"[14/03/2026, 10:00:00] Rui: done{MARK}<This message was edited>\n"
    )
    pack(root / "WhatsApp Chat with Ana Lima.zip", {"_chat.txt": first, "00000019-PHOTO-1.jpg": b"abc"})
    pack(
        root / "WhatsApp Chat with Ana Lima (2).ZIP",
        {"_chat.txt": second, "00000004-PHOTO-1.jpg": b"abc", "00000005-PHOTO-2.JPG": b"defgh"},
    )
    pack(root / "two.zip", {"a/One.txt": "13/03/2026, 09:00 - Zoe: x", "b/Two.txt": "13/03/2026, 09:00 - Yan: y"})
    pack(root / "silent.zip", {"x.jpg": b"1"})
    (root / "bad.zip").write_text("no archive")
    for sub in ("s1", "s2"):
        (root / sub).mkdir()
        (root / sub / "_chat.txt").write_text("noise\n1/2/26, 9:00 AM - Z: hi from %s\n" % sub, encoding="utf-16")
    (root / "notes.pdf").write_text("ignored")
    (root / "Café.txt").write_bytes("13/03/2026, 09:00 - Zoë: latin".encode("cp1252"))
    return root


@pytest.fixture(scope="module")
def archive(spark, folder):
    return build_archive(spark, [str(folder), "/nowhere", str(folder / "notes.pdf")])


def test_units_are_in_path_order_with_unique_labels(archive):
    rows = archive.units.orderBy("unit_idx").collect()
    assert [(r.label, r.title) for r in rows] == [
        ("Café.txt", "Café"),
        ("WhatsApp Chat with Ana Lima (2).ZIP", "Ana Lima"),
        ("WhatsApp Chat with Ana Lima.zip", "Ana Lima"),
        ("_chat.txt", "Group (1 participants)"),
        ("_chat.txt (2)", "Group (1 participants)"),
        ("two.zip/One.txt", "One"),
        ("two.zip/Two.txt", "Two"),
    ]
    assert [r.unit_idx for r in rows] == [r.source_idx for r in rows] == list(range(7))


def test_warnings(archive):
    found = {(r.unit_idx, r.code) for r in archive.warnings.collect()}
    assert {(None, c) for c in ("missing_input", "unsupported_input", "bad_archive", "no_transcript")} <= found
    assert {(3, "ignored_lines"), (4, "ignored_lines"), (3, "ambiguous_dates")} <= found


def test_messages_are_merged_and_media_resolved(archive):
    chat = archive.chats.filter("title = 'Ana Lima'").first()
    rows = archive.messages.filter(F.col("chat_id") == chat.chat_id).orderBy("msg_idx").collect()
    assert [(r.text, r.kind, r.sources) for r in rows] == [
        ("Messages are private.", "system", [2]),
        ("Good morning", "text", [2]),
        ("Morning.", "text", [1, 2]),
        ("", "media", [1, 2]),
        ("", "media", [1, 2]),
        ("done", "text", [1]),
    ]
    assert rows[3].attachment.src == "#" + rows[3].attachment.content_hash and rows[4].attachment.size == 5
    uris = {r.media_key: r.src for r in archive.media_catalog.collect()}
    assert uris[rows[3].attachment.content_hash] == "data:image/jpeg;base64,YWJj"
    pages = [r.document for r in archive.documents(embed=True).collect()]
    assert sum(page.count("data:image/jpeg;base64,YWJj") for page in pages) == 1
    assert rows[5].edited and (chat.is_group, chat.n_sources, chat.n_messages) == (False, 2, 6)
    assert archive.owner == "Rui"
    assert [r.outgoing for r in rows] == [False, False, True, True, False, True]


def test_decoding(archive):
    texts = {r.text for r in archive.messages.select("text").collect()}
    assert {"latin", "hi from s1", "hi from s2"} <= texts
    assert S.decode_text("a€".encode("utf-8-sig")) == "a€"
    assert S.decode_text("a€".encode("cp1252")) == "a€"
    assert S.decode_text(b"ab") == "ab" and S.decode_text(b"\x81\xff") == "\x81\xff"


def test_single_files_and_options(spark, folder):
    one = build_archive(
        spark,
        [str(folder / "s1" / "_chat.txt"), str(folder / "WhatsApp Chat with Ana Lima.zip")],
        stitch_mode="titles",
        owner_override="ana limma",
        date_order="mdy",
        media_mode="external",
    )
    assert [r.label for r in one.units.orderBy("unit_idx").collect()] == ["_chat.txt", "WhatsApp Chat with Ana Lima.zip"]
    assert one.owner == "Ana Lima"
    assert one.messages.agg(F.max("ts")).first()[0].month == 10
    catalog = one.media_catalog.collect()
    assert [(r.name, r.status, r.src) for r in catalog] == [("00000019-PHOTO-1.jpg", "copied", "media/00000019-PHOTO-1.jpg")]


def test_overlapping_inputs_are_read_once_but_count_twice(spark, folder):
    sub = folder / "s1"
    got = S.read_exports(spark, [str(sub), str(sub / "_chat.txt"), str(folder / "s2") + "/"])
    assert [r.label for r in got.units.orderBy("unit_idx").collect()] == ["_chat.txt", "_chat.txt (2)", "_chat.txt (3)"]
    assert got.transcripts.count() == 3


def test_empty_folder(spark, tmp_path):
    got = S.read_exports(spark, [str(tmp_path)])
    assert got.units.isEmpty() and [r.code for r in got.warnings.collect()] == ["empty_folder"]


def test_member_names(spark):
    info = zipfile.ZipInfo("José.txt".encode("utf-8").decode("cp437"))
    assert S.member_name(info) == "José.txt"
    info.flag_bits = 0x800
    assert S.member_name(info) != "José.txt"
    frame = spark.createDataFrame([("../a\\.\\b//c.txt",), ("/x",), ("..",)], "n string")
    assert [r[0] for r in frame.select(S.sanitize_member(F.col("n"))).collect()] == ["a/b/c.txt", "x", ""]


def test_members_of_archives_in_a_column(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("d/", "")
        z.writestr("d/_chat.txt", "x")
        z.writestr("../up.jpg", b"y")
    frame = spark.createDataFrame([("/a/My Chat.zip", buffer.getvalue()), ("/b.zip", b"?")], "path string, content binary")
    rows = S.expand_archives(frame)
    assert sorted((r.archive, r.path or "", r.error is None) for r in rows.collect()) == [
        ("/a/My Chat.zip", "d/_chat.txt", True), ("/a/My Chat.zip", "up.jpg", True), ("/b.zip", "", False),
    ]
    unit = S.archive_units(rows).first()
    assert (unit.hint_title, unit.n_transcripts) == ("My Chat", 1)


def test_files_resolve_within_their_folder(spark):
    members = spark.createDataFrame(
        [("z", "a/b/P.jpg", b"1"), ("z", "a/p.JPG", b"22"), ("z", "q.jpg", b"3"), ("", "/m/n/o.jpg", b"4")],
        "archive string, path string, content binary",
    )
    roots = spark.createDataFrame([("z", "a"), ("z", "a/b"), ("", "/m")], "archive string, media_root string")
    got = {(r.archive, r.media_root, r.folded_name): r.path for r in S.media_files(members, roots).collect()}
    assert got == {
        ("z", "a", "p.jpg"): "a/b/P.jpg", ("z", "a/b", "p.jpg"): "a/b/P.jpg", ("", "/m", "o.jpg"): "/m/n/o.jpg",
    }
