"""Owner, chats, media, views and sinks on small hand-made archives."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import attachment, raw, row, units_table
from threadlake.operators import chats as C
from threadlake.operators import dedup, media, owner, ranking
from threadlake.operators import views as V
from threadlake.plans.archive import Archive, merge_exports
from threadlake.sinks import documents as K
from threadlake.sinks import tables as T

PHOTO = attachment("IMG 1.jpg", content_hash="h1", path="/x/1.jpg", size=9, src="media/1")

ROWS = [
    row(0, 0, (10, 8, 0), "Ana", "hello *world*"),
    row(0, 1, (10, 8, 1), "Rui", "hi"),
    row(0, 2, (10, 8, 2), "Rui", "", PHOTO),
    row(0, 3, (12, 8, 2), "Rui", "", attachment("gone.jpg")),
    row(1, 0, (10, 9, 0), "Eva", "Été à Évora"),
    row(1, 1, (10, 9, 1), "Rui", "morning"),
    row(1, 2, (10, 9, 20), None, "Eva left"),
    row(2, 0, (11, 9, 0), "Eva", "", attachment("IMG-1.jpg", content_hash="h1", path="/x/2.jpg", size=9, src="media/1")),
    row(2, 1, (11, 9, 1), "Gil", "", attachment("big.mp4", "video", content_hash="h2", path="/x/b", size=99)),
    row(2, 2, (11, 9, 2), "Hal", "", attachment(omitted=True)),
    row(2, 3, (11, 9, 3), "Ida", "bye"),
]


@pytest.fixture(scope="module")
def made(spark):
    units = units_table(spark, ["Ana", "Eva", "_chat"])
    unit_chat, messages, name = merge_exports(units, raw(spark, ROWS))
    messages = messages.cache()
    chats = C.build_chats(messages, unit_chat, name)
    return units, unit_chat, messages, chats, name


def test_owner(made, spark):
    _, unit_chat, messages, _, name = made
    assert name == "Rui"
    scores = owner.sender_scores(messages, C.first_titles(unit_chat))
    got = {r.sender: (r.messages, r.chats, r.titled_as_other) for r in scores.collect()}
    assert got["Rui"] == (4, 2, 0) and got["Eva"] == (2, 2, 1)

    def pick(override):
        return owner.detect_owner(scores, override).first().owner

    assert [pick(o) for o in (None, " eVA ", "Evva", "Quentin")] == ["Rui", "Eva", "Eva", "Quentin"]
    assert owner.detect_owner(scores.limit(0)).first().owner is None
    assert owner.detect_owner(scores.limit(0), "X").first().owner is None


def test_single_chat_owner_is_not_the_title(spark):
    rows = [row(0, 0, (10, 8, 0), "Ana", "a"), row(0, 1, (10, 8, 1), "Rui", "b")]
    assert merge_exports(units_table(spark, ["Ana"]), raw(spark, rows))[2] == "Rui"


def test_chat_titles_order_and_flags(made):
    chats = made[3].orderBy("chat_rank").collect()
    assert [(c.title, c.key, c.is_group, c.n_people) for c in chats] == [
        ("Ana", "ana", False, 2),
        ("Eva, Gil, Hal +1", "eva, gil, hal +1", True, 4),
        ("Eva", "eva", True, 2),
    ]


def test_repeated_keys_are_numbered(spark):
    frame = spark.createDataFrame(
        [(0, 0, "A"), (1, 1, "a "), (2, 2, ""), (3, 3, "A")], "chat_id bigint, chat_rank bigint, title string"
    )
    assert [r.key for r in C.number_keys(frame).orderBy("chat_rank").collect()] == ["a", "a-2", "chat-2", "a-3"]


def test_chats_without_messages_are_dropped(spark):
    unit_chat, messages, name = merge_exports(units_table(spark, ["Ana", "Empty"]), raw(spark, ROWS[:2]))
    assert [c.title for c in C.build_chats(messages, unit_chat, name).collect()] == ["Ana"]


def test_no_messages_at_all(spark):
    unit_chat, messages, name = merge_exports(units_table(spark, ["A"]), raw(spark, []))
    assert name is None and messages.isEmpty() and C.build_chats(messages, unit_chat, name).isEmpty()


def test_filters(made):
    _, _, messages, chats, _ = made

    def titles(which):
        return sorted(r.title for r in V.filter_chats(chats, messages, which).collect())

    assert titles("direct") == ["Ana"] and titles("group") == ["Eva", "Eva, Gil, Hal +1"]
    assert titles("media") == ["Ana", "Eva, Gil, Hal +1"] and len(titles("all")) == 3
    with pytest.raises(ValueError):
        V.filter_chats(chats, messages, "odd")


def test_search(made):
    _, _, messages, chats, _ = made

    def hits(q, **more):
        return sorted((r.title, r.msg_idx, r.snippet) for r in V.search(messages, chats, q, **more).collect())

    assert hits("ÉTE") == [("Eva", 0, "«Été» à Évora")]
    assert hits("img") == [("Ana", 2, "«IMG» 1.jpg"), ("Eva, Gil, Hal +1", 0, "«IMG»-1.jpg")]
    assert hits("o", limit=9) == [] and hits("ello", which="group") == []
    assert len(hits("mg", limit=1)) == 1
    plan = V.search(messages, chats, "hello", limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_snippet_keeps_its_place_behind_accents(spark):
    text = "é" * 30 + " needle " + "z" * 200
    frame = spark.createDataFrame([(text,)], "t string")
    got = frame.select(V.snippet(F.col("t"), "needle")).first()[0]
    at = text.index("needle")
    assert got == "…" + text[at - 34:at] + "«needle»" + text[at + 6:at + 96]
    dotted = spark.createDataFrame([("\u0130\u0130\u0130\u0130 hello needle end",)], "t string")
    assert dotted.select(V.snippet(F.col("t"), "needle")).first()[0] == "\u0130\u0130\u0130\u0130 hello «needle» end"


def test_previews(made):
    _, _, messages, chats, _ = made
    got = {r.title: r.prefix + r.body for r in V.last_previews(messages, chats).collect()}
    assert got == {"Ana": "Photo", "Eva": "Eva left", "Eva, Gil, Hal +1": "Ida: bye"}


def test_headers(made):
    _, _, messages, chats, name = made
    got = {r.chat_id: r.line for r in V.chat_header(C.participants(messages), chats, name).collect()}
    assert got == {0: "10/03/2026 – 12/03/2026  ·  4 messages", 1: "Eva", 2: "Eva, Gil, Hal, Ida"}


def test_statistics(made):
    units, unit_chat, messages, chats, name = made
    share = {(r.chat_id, r.sender): (r.n, r.pct) for r in V.sender_share(messages).collect()}
    assert share[(0, "Rui")] == (3, 75) and share[(1, "Eva")] == (1, 33)
    kinds = {(r.chat_id, r.kind): (r.n, r.pct) for r in V.attachment_share(messages).collect()}
    assert kinds[(2, "video")] == (1, 33) and kinds[(0, "image")] == (2, 100)
    days = {r.chat_id: r.span_days for r in V.chat_overview(messages).collect()}
    assert days == {0: 3, 1: 1, 2: 1}
    stats = V.archive_stats(messages, units, name).first()
    assert (stats.conversations, stats.messages, stats.attachments, stats.sources, stats.owner) == (3, 11, 5, 3, "Rui")
    assert [(r.chat_id, r.pct) for r in V.busiest_chats(chats, 1).collect()] == [(0, 36)]
    assert {r.label: r.n for r in V.archive_sources(messages, units).collect()} == {"0.zip": 4, "1.zip": 3, "2.zip": 4}


def test_media_views(made):
    _, _, messages, chats, _ = made
    assert [(r.chat_id, r.filename) for r in V.latest_media(messages, chats, 10).collect()] == [(2, "IMG-1.jpg"), (0, "IMG 1.jpg")]
    ordinals = {(r.chat_id, r.msg_idx): (r.media_idx, r.viewable_idx) for r in V.media_ordinals(messages).collect()}
    assert ordinals == {(0, 2): (0, 0), (0, 3): (1, None), (2, 0): (0, 0), (2, 1): (1, None), (2, 2): (2, None)}
    assert V.latest_media_per_chat(messages, 1).count() == 2


def test_media_catalog_and_report(made, spark):
    _, _, messages, chats, _ = made
    catalog = media.media_catalog(messages, chats, max_inline_bytes=50)
    assert {(r.media_key, r.filename, r.n_messages, r.status) for r in catalog.collect()} == {
        ("h1", "IMG 1.jpg", 2, "inlined"), ("h2", "big.mp4", 1, "copied"),
    }
    report = media.media_report(messages, catalog)
    assert report.first().asDict() == {
        "inlined": 1, "copied": 1, "missing": 2, "bytes_embedded": 12,
    }
    assert {r.status for r in media.media_catalog(messages, chats).collect()} == {"inlined"}
    assert {(r.name, r.src) for r in catalog.filter("status = 'copied'").collect()} == {("big.mp4", "media/big.mp4")}
    contents = spark.createDataFrame([("/x/1.jpg", b"123456789" * 20)], "path string, content binary")
    filled = media.inline_sources(catalog, contents)
    uri = filled.filter("media_key = 'h1'").first().src
    assert uri.startswith("data:image/jpeg;base64,") and not set(uri) & set("\r\n ")
    by_key = media.link_sources(messages, filled).filter("chat_id = 2 and msg_idx = 0").first()
    assert by_key.attachment.src == "#h1"
    linked = media.link_sources(messages, filled, embed=True)
    got = {(r.chat_id, r.msg_idx): (r.attachment.src[:4], r.attachment.kind) for r in linked.filter("attachment is not null").collect()}
    assert got == {(0, 2): ("data", "image"), (0, 3): ("", "image"), (2, 0): ("data", "image"), (2, 1): ("medi", "video"), (2, 2): ("", "missing")}
    names = media.media_catalog(messages, chats, "external")
    assert {r.name for r in names.collect()} == {"IMG_1.jpg", "big.mp4"}
    assert {r.status for r in media.media_catalog(messages, chats, "none").collect()} == {"none"}


def test_external_names_are_unique(spark):
    rows = [row(0, i, (10, 8, i), "A", "", attachment(n, content_hash=f"h{i}", path=f"/{i}")) for i, n in
            enumerate(["a b.jpg", "a_b.jpg", "A*b.JPG", "noext", "noext", "?"])]
    _, messages, _ = merge_exports(units_table(spark, ["A"]), raw(spark, rows))
    got = {r.media_key: r.name for r in media.media_catalog(messages, mode="external").collect()}
    assert got == {"h0": "a_b.jpg", "h1": "a_b_2.jpg", "h2": "A_b_3.JPG", "h3": "noext", "h4": "noext_2", "h5": "_"}


def run_rows(spark):
    day = dt.datetime(2026, 1, 1, 23, 50)
    rows = [(0, "A", "text"), (5, "A", "text"), (8, "A", "text"), (9, "B", "text"), (9, None, "system"), (9, "B", "text"),
            (25, "B", "text"), (40, "B", "text"), (41, "B", "text")]
    return spark.createDataFrame(
        [(0, i, day + dt.timedelta(minutes=m), s, k) for i, (m, s, k) in enumerate(rows)],
        "chat_id bigint, msg_idx bigint, ts timestamp_ntz, sender string, kind string",
    )


@pytest.mark.parametrize("bucket", [1 << 16, 2])
def test_sender_runs(spark, monkeypatch, bucket):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", bucket)
    runs = V.sender_runs(run_rows(spark))
    got = [(r.run_start, r.run_no) for r in runs.orderBy("msg_idx").collect()]
    assert got == [(True, 1), (False, 1), (False, 1), (True, 2), (False, None), (True, 3), (True, 4), (False, 4), (False, 4)]
    assert [r.n_messages for r in V.run_lengths(runs).orderBy("run_no").collect()] == [3, 1, 1, 3]


def test_days_and_pages(spark):
    messages = run_rows(spark)
    days = V.day_separators(messages, dt.datetime(2026, 1, 2, 12, 0)).orderBy("day").collect()
    assert [(d.first_idx, d.n, d.label) for d in days] == [(0, 6, "Yesterday"), (6, 3, "Today")]
    chats = spark.createDataFrame([(0, 700), (1, 100), (2, 900)], "chat_id bigint, n_messages bigint")
    got = {r.chat_id: r.above for r in V.page_start(chats, focus={2: 400}).collect()}
    assert got == {0: 450, 1: 0, 2: 317}
    assert {r.chat_id: r.above for r in V.page_start(chats, steps_back=1).collect()} == {0: 200, 1: 0, 2: 400}
    starts = spark.createDataFrame([(0, 7)], "chat_id bigint, from_idx bigint")
    assert V.page_window(messages, starts).count() == 2


def test_documents(made):
    units, unit_chat, messages, chats, name = made
    pages = K.chat_documents(messages, chats, C.participants(messages), unit_chat, 80).orderBy("chat_rank", "page").collect()
    docs = [json.loads(p.document) for p in pages]
    ana = [d for d in docs if d["id"] == "ana"]
    assert [len(d["msgs"]) for d in ana] == [2, 1, 1] and ana[0]["people"] == ["Rui", "Ana"] and ana[0]["sources"] == [0]
    assert ana[0]["msgs"][0] == {"t": 1773129600, "w": 1, "b": "hello *world*", "r": [0]}
    assert ana[1]["msgs"][0] == {
        "t": 1773129720, "w": 0, "k": "m", "o": 1, "r": [0],
        "a": {"n": "IMG 1.jpg", "k": "image", "m": "image/jpeg", "s": "media/1", "z": 9},
    }
    notice = [m for d in docs if d["id"] == "eva" for m in d["msgs"]][-1]
    assert notice == {"t": 1773134400, "k": "y", "b": "Eva left", "r": [1]}
    group = [p for d in docs if d["id"].startswith("eva,") for p in d["people"]]
    assert group == ["Eva", "Gil", "Hal", "Ida"]
    head = K.archive_header(chats, units, name).first()
    assert (head.title, head.owner, head.n_sources) == ("WhatsApp archive · 3 conversations", "Rui", 3)


def test_tables_on_disk(made, spark, tmp_path):
    units, unit_chat, messages, chats, name = made
    empty = spark.createDataFrame([], "unit_idx bigint, code string, message string")
    archive = Archive(units, unit_chat, messages, chats, C.participants(messages), media.media_catalog(messages), spark.createDataFrame([], "media_key string"), empty, name)
    T.write_archive(archive, str(tmp_path / "a"), buckets=4)
    back = T.read_table(spark, str(tmp_path / "a"), "messages")
    assert back.count() == messages.count()
    def rows(frame):
        return sorted((r.chat_id, r.msg_idx, r.text) for r in frame.collect())

    one = T.read_chat(spark, str(tmp_path / "a"), 2)
    assert one.columns == messages.columns and rows(one) == rows(messages.filter("chat_id = 2")) and one.count() == 4
    assert len(one.inputFiles()) == 1 < len(T.read_table(spark, str(tmp_path / "a"), "messages").inputFiles())
    assert rows(T.read_chat(spark, str(tmp_path / "a"), 2, 1, 2)) == rows(messages.filter("chat_id = 2 AND msg_idx BETWEEN 1 AND 2"))
    assert T.read_chat(spark, str(tmp_path / "a"), 77).collect() == [] == T.read_chat(spark, str(tmp_path / "a"), 2, 50).collect()
    linked = T.read_link(spark, str(tmp_path / "a"), "eva", 1)
    assert linked.first().text == "morning" and linked.first().title == "Eva" and len(linked.inputFiles()) == 1
    assert T.read_link(spark, str(tmp_path / "a"), "nobody", 1).collect() == []
    T.write_documents(archive.documents(80), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).count() == archive.documents(80).count()
    assert dedup.merge_stats(back).first().messages == 11
    with pytest.raises(ValueError):
        T.read_table(spark, str(tmp_path / "a"), "odd")


def test_deep_link(made):
    _, _, messages, chats, _ = made
    assert V.deep_link(messages, chats, "eva", 1).first().text == "morning"


def test_pages_are_balanced_by_weight(made, spark):
    """Messages of very different lengths, and one that is longer than a page."""
    rng = random.Random(4)
    texts = ["x" * (40_000 if i == 30 else rng.choice([0, 5, 900])) for i in range(80)]
    _, unit_chat, messages, chats, _ = made
    one = messages.filter("chat_id = 2 AND msg_idx = 0").drop("msg_idx", "text")
    frame = spark.createDataFrame(list(enumerate(texts)), "msg_idx bigint, text string")
    many = one.withColumn("x", F.lit(1)).join(frame.withColumn("x", F.lit(1)), "x").select(*messages.columns)
    pages = K.chat_documents(many, chats, C.participants(many), unit_chat, 2000).filter("chat_id = 2").orderBy("page").collect()
    docs = [json.loads(p.document) for p in pages]
    assert [m.get("b", "") for d in docs for m in d["msgs"]] == texts
    sizes = [sum(len(json.dumps(m)) for m in d["msgs"]) for d in docs]
    assert len(docs) > 10 and sorted(sizes)[-2] < 2000 + 1100 and [d["page"] for d in docs] == sorted(d["page"] for d in docs)


def test_pages_of_the_archive(made, spark):
    units, _, _, chats, name = made
    notes = spark.createDataFrame(
        [(2, "b", "second"), (None, "a", "of no export"), (2, "a", "first")], "unit_idx bigint, code string, message string"
    )
    docs = [json.loads(r.document) for r in K.archive_documents(chats, units, notes, name, page_bytes=30).orderBy("page").collect()]
    assert len(docs) > 1 and {d["owner"] for d in docs} == {"Rui"} and {d["n_sources"] for d in docs} == {3}
    labels = [r.label for r in units.orderBy("source_idx").select("source_idx", "label").distinct().orderBy("source_idx").collect()]
    assert [s for d in docs for s in d["sources"]] == labels
    assert [n["message"] for d in docs for n in d["notes"]] == ["of no export", "first", "second"]
    bare = K.archive_documents(chats.limit(0), units.limit(0), notes.limit(0), None, "Empty").collect()
    assert [json.loads(r.document)["title"] for r in bare] == ["Empty"]
