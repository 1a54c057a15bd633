"""The engine's operators as queries over the given tables.

Each query takes ``(spark, folder)`` and returns a frame of plain columns.  Chats
are the conversations themselves unless a query is about stitching.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.functions import display as D
from threadlake.functions import text as X
from threadlake.operators import chats as C
from threadlake.operators import dedup, media, owner, stitch
from threadlake.operators import transcripts as P
from threadlake.operators import views as V
from threadlake.operators.ranking import bucketed_index, dense_index, with_previous
from threadlake.operators.search_index import SearchIndex
from threadlake.plans import fixtures as fx
from threadlake.plans.archive import merge_exports
from threadlake.session import materialize, run_folder
from threadlake.sinks import documents as K
from threadlake.sinks import tables as T
from threadlake.sources import exports as S

Query = Callable[[SparkSession, str], DataFrame]

NOW = dt.datetime(2026, 1, 6, 12, 0, 0)
SEARCH_TERM = "ere"

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def one_line(column: str) -> Column:
    """A whole text as one line of a transcript."""
    return F.translate(column, "\r\n", "  ")


# --- shared inputs -------------------------------------------------------------------------


def _keyed(spark, folder):
    v = fx.simulated(spark, folder)
    return v, dedup.with_keys(dedup.assign_chats(fx.raw_messages(v), fx.unit_chat(v)))


def _messages(spark, folder) -> tuple[DataFrame, DataFrame]:
    v = fx.simulated(spark, folder)
    unit_chat = fx.unit_chat(v)
    return dedup.merge_messages(fx.raw_messages(v), unit_chat), unit_chat


def _unordered(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Merged messages for aggregates, which need no place in the chat."""
    v = fx.simulated(spark, folder)
    unit_chat = fx.unit_chat(v)
    return dedup.merge_messages(fx.raw_messages(v), unit_chat, ranked=False), unit_chat


def _with_owner(messages: DataFrame) -> DataFrame:
    return owner.mark_outgoing(messages, fx.OWNER)


def _chats(messages: DataFrame, unit_chat: DataFrame) -> DataFrame:
    return C.build_chats(messages, unit_chat, fx.OWNER)


def _linked(messages: DataFrame) -> DataFrame:
    """Messages whose named attachments all have a link, as after the media step."""
    att = F.col("attachment")
    link = F.when(att["omitted"], F.lit("")).otherwise(F.concat(F.lit("media/"), att["filename"]))
    return messages.withColumn(
        "attachment", F.when(att.isNotNull(), att.withField("src", link))
    )


# --- overlap -------------------------------------------------------------------------------


@query
def dedup_messages(spark, folder):
    _, keyed = _keyed(spark, folder)
    return dedup.collapse_copies(keyed).select(
        "chat_id",
        "ts",
        "sender",
        "text",
        "kind",
        F.col("attachment.filename").alias("filename"),
        "has_seconds",
        "first_unit",
        "first_no",
        joined("sources").alias("sources"),
    )


@query
def pair_placeholders(spark, folder):
    _, keyed = _keyed(spark, folder)
    return dedup.pair_placeholders(dedup.collapse_copies(keyed)).select(
        "chat_id",
        "first_unit",
        "first_no",
        "kind",
        F.coalesce("attachment.omitted", F.lit(False)).alias("omitted"),
        joined("sources").alias("sources"),
    )


@query
def chronological_index(spark, folder):
    messages, _ = _messages(spark, folder)
    return messages.select("chat_id", "msg_idx", "ts", "sender", "kind", "first_unit", "first_no")


@query
def merge_stats(spark, folder):
    messages, _ = _unordered(spark, folder)
    return dedup.merge_stats(messages)


# --- stitching -----------------------------------------------------------------------------


def _profiles(spark, folder):
    v = fx.simulated(spark, folder)
    return v, stitch.unit_profiles(fx.units(v), fx.raw_messages(v))


@query
def unit_profiles(spark, folder):
    _, profiles = _profiles(spark, folder)
    return profiles.select("unit_idx", "norm_title", "placeholder", "n_senders", "groupish", "n_messages")


@query
def same_title_edges(spark, folder):
    _, profiles = _profiles(spark, folder)
    return stitch.same_title_edges(profiles).select("unit_idx", "hub")


@query
def same_people_edges(spark, folder):
    _, profiles = _profiles(spark, folder)
    return stitch.same_people_edges(profiles).select("unit_idx", "hub")


def _neighbours(profiles: DataFrame) -> DataFrame:
    """Each export with the one before it that has the same people."""
    known = profiles.filter(F.col("people_key").isNotNull()).select("people_key", "unit_idx")
    placed = dense_index(known, ["people_key"], "unit_idx", "pos")
    linked = with_previous(placed, ["people_key"], "pos", ["unit_idx"])
    return linked.filter(F.col("prev_unit_idx").isNotNull()).select(
        F.col("prev_unit_idx").alias("a"), F.col("unit_idx").alias("b")
    )


@query
def unit_overlap(spark, folder):
    v, profiles = _profiles(spark, folder)
    keys = stitch.message_keys(fx.raw_messages(v))
    return stitch.overlap(_neighbours(profiles), keys)


@query
def close_titles(spark, folder):
    """Exports that share a message and have nearly equal titles."""
    v, profiles = _profiles(spark, folder)
    return stitch.close_title_pairs(stitch.message_keys(fx.raw_messages(v)), profiles)


@query
def stitch_components(spark, folder):
    v = fx.simulated(spark, folder)
    grouped = stitch.stitch(fx.units(v), fx.raw_messages(v))
    return grouped.unit_chat.select("unit_idx", "chat_id")


@query
def stitch_exact_titles(spark, folder):
    v = fx.simulated(spark, folder)
    grouped = stitch.stitch(fx.units(v), fx.raw_messages(v), "titles")
    return grouped.unit_chat.select("unit_idx", "chat_id")


@query
def merged_archive(spark, folder):
    """Stitch, merge, detect the owner and list the chats: the whole engine after parsing."""
    v = fx.simulated(spark, folder)
    unit_chat, messages, name = merge_exports(fx.units(v), fx.raw_messages(v))
    return C.build_chats(messages, unit_chat, name).select(
        "chat_id", "title", "is_group", "n_people", "n_sources", "owner", "start_ts", "end_ts", "n_messages"
    )


# --- owner -----------------------------------------------------------------------------------


def _scores(spark, folder):
    messages, unit_chat = _messages(spark, folder)
    return owner.sender_scores(messages, C.first_titles(unit_chat))


@query
def sender_scores(spark, folder):
    return _scores(spark, folder).select("sender", "messages", "chats", "titled_as_other")


@query
def detect_owner(spark, folder):
    return owner.detect_owner(_scores(spark, folder))


@query
def owner_override_exact(spark, folder):
    return owner.detect_owner(_scores(spark, folder), "  CONTACT   7 ")


@query
def owner_override_fuzzy(spark, folder):
    return owner.detect_owner(_scores(spark, folder), "owner exampel")


@query
def owner_override_unknown(spark, folder):
    return owner.detect_owner(_scores(spark, folder), "Quentin Zyx")


@query
def outgoing_flags(spark, folder):
    messages, _ = _unordered(spark, folder)
    return (
        _with_owner(messages)
        .groupBy("chat_id")
        .agg(F.count_if("outgoing").alias("outgoing"), F.count(F.lit(1)).alias("n"))
    )


# --- chats ------------------------------------------------------------------------------------


@query
def chat_list(spark, folder):
    messages, unit_chat = _messages(spark, folder)
    return _chats(messages, unit_chat).select(
        "chat_rank", "chat_id", "title", "key", "is_group", "n_people", "n_sources",
        "start_ts", "end_ts", "n_messages",
    )


@query
def direct_chats(spark, folder):
    messages, unit_chat = _messages(spark, folder)
    chats = _chats(messages, unit_chat)
    return V.filter_chats(chats, messages, "direct").select("chat_id", "title")


@query
def media_chats(spark, folder):
    messages, unit_chat = _messages(spark, folder)
    chats = _chats(messages, unit_chat)
    return V.filter_chats(chats, messages, "media").select("chat_id", "title")


@query
def participants(spark, folder):
    messages, _ = _unordered(spark, folder)
    return C.participants(messages)


@query
def chat_header(spark, folder):
    messages, unit_chat = _messages(spark, folder)
    return V.chat_header(C.participants(messages), _chats(messages, unit_chat), fx.OWNER)


@query
def archive_title(spark, folder):
    messages, unit_chat = _messages(spark, folder)
    return C.archive_title(_chats(messages, unit_chat), "Archive")


# --- transcripts --------------------------------------------------------------------------------


@query
def parse_roundtrip(spark, folder):
    v = fx.simulated(spark, folder)
    return P.parse_splits(fx.split_transcripts(v), "dmy").messages.select(
        "unit_idx",
        "msg_no",
        "ts",
        "sender",
        "kind",
        F.coalesce("attachment.omitted", F.lit(False)).alias("omitted"),
        F.nullif("attachment.filename", F.lit("")).alias("filename"),
        "has_seconds",
        X.strip_right(F.col("text")).alias("text"),
    )


@query
def date_order_sniff(spark, folder):
    parsed = P.parse_splits(fx.split_lines(fx.event_lines(spark, folder), fx.EVENTS_OF_SPLIT))
    orders = parsed.counts.select("unit_idx", "date_order", "ambiguous")
    spans = (
        parsed.messages.groupBy("unit_idx")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    )
    return orders.join(spans, "unit_idx")


@query
def attachment_kinds(spark, folder):
    """File names of every type, written the way each platform writes attachments."""
    names = _file_names(spark, folder)
    lines = names.select(
        "doc_id",
        F.lit("Sender").alias("sender"),
        F.when(F.col("doc_id") % 2 == 0, F.concat("name", F.lit(" (file attached)")))
        .otherwise(F.concat(F.lit("‎<attached: "), "name", F.lit(">")))
        .alias("head"),
    )
    return P.classify_body(lines).select(
        "doc_id",
        "kind",
        F.col("attachment.filename").alias("filename"),
        F.col("attachment.kind").alias("attachment_kind"),
        F.col("attachment.mime").alias("mime"),
    )


EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "webp", "heic", "bmp", "mp4", "mov", "3gp", "webm", "avi",
    "opus", "ogg", "m4a", "aac", "mp3", "wav", "amr", "vcf", "pdf", "docx", "bin",
)


def _file_names(spark, folder) -> DataFrame:
    docs = fx.table(spark, folder, "documents")
    suffix = F.element_at(
        F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int")
    )
    prefix = F.when(F.col("doc_id") % 5 == 0, F.lit("PTT-")).otherwise("FILE-")
    return docs.select(
        "doc_id", F.concat(prefix, F.col("doc_id").cast("string"), F.lit("."), suffix).alias("name")
    )


@query
def message_kinds(spark, folder):
    """Bodies of every kind around the texts of the conversations."""
    rows = fx.table(spark, folder, "conversations")
    style = F.col("conv_id") % 8
    first = one_line("text")
    head = (
        F.when(style == 0, F.lit("‎This message was deleted"))
        .when(style == 1, F.concat(F.lit("POLL: "), first))
        .when(style == 2, F.lit("Missed voice call"))
        .when(style == 3, F.concat(first, F.lit(" https://maps.google.com/?q=1,2")))
        .when(style == 4, F.lit("image omitted"))
        .when(style == 5, F.concat(first, F.lit("‎<This message was edited>")))
        .when(style == 6, F.concat(F.lit("Card-"), F.col("turn").cast("string"), F.lit(".vcf (file attached)")))
        .otherwise(first)
    )
    lines = rows.select(
        "conv_id",
        "turn",
        F.when(F.col("role") != "system", F.col("role")).alias("sender"),
        head.alias("head"),
    )
    return P.classify_body(lines).select("conv_id", "turn", "kind", "edited", F.col("head").alias("text"))


@query
def system_lines(spark, folder):
    """Which header lines have a sender: names, notices with a colon, marked notices."""
    rows = fx.table(spark, folder, "conversations")
    style = F.col("turn") % 4
    first = one_line("text")
    line = (
        F.when(style == 0, F.concat("role", F.lit(": "), first))
        .when(style == 1, F.concat("role", F.lit(' changed the subject to "Q1: close" '), first))
        .when(style == 2, F.concat(F.lit("‎"), "role", F.lit(": "), first))
        .otherwise(F.concat(F.repeat("role", F.lit(20)), F.lit(": "), first))
    )
    lines = rows.select("conv_id", "turn", line.alias("line"))
    return P.split_sender(lines).select("conv_id", "turn", "sender", F.col("head").alias("text"))


@query
def rare_senders(spark, folder):
    """A name that reads like a notice is one if it writes once in a transcript."""
    rows = fx.table(spark, folder, "conversations")
    odd = (F.col("turn") == 1) | ((F.col("turn") == 2) & (F.col("conv_id") % 2 == 0))
    sender = F.when(odd, F.lit("Zoe l​eft")).otherwise(F.col("role"))
    lines = rows.select(
        F.col("conv_id").alias("unit_idx"),
        F.col("turn").alias("msg_no"),
        F.concat(
            F.lit("13/01/2026, 10:0"), F.col("turn").cast("string"), F.lit(" - "), sender, F.lit(": "),
            F.trim(one_line("text")),
        ).alias("line"),
    )
    return P.parse_messages(fx.join_lines(lines)).select("unit_idx", "msg_no", "sender", "kind", "text")


@query
def parse_warnings(spark, folder):
    """Transcripts with lines before the first message, without messages, without clear dates."""
    rows = fx.table(spark, folder, "conversations")
    style = F.col("conv_id") % 4
    stamp = F.when(style == 1, F.lit("13/01/2026, 10:00 - A: ")).otherwise("03/01/2026, 10:00 - A: ")
    loose = (style == 3) | ((style == 2) & (F.col("turn") == 0))
    word = one_line("text")
    lines = rows.select(
        F.col("conv_id").alias("unit_idx"),
        F.col("turn").alias("msg_no"),
        F.when(loose, F.concat(F.lit("x "), word)).otherwise(F.concat(stamp, word)).alias("line"),
    )
    texts = fx.split_lines(lines, 2)
    labels = texts.select("unit_idx").distinct().select(
        "unit_idx", F.concat(F.lit("t"), F.col("unit_idx").cast("string"), F.lit(".txt")).alias("label")
    )
    return P.parse_warnings(P.parse_splits(texts).counts, labels)


# --- names and archives ------------------------------------------------------------------------


@query
def clean_titles(spark, folder):
    docs = fx.table(spark, folder, "documents")
    who = F.concat("lang", F.lit("."), F.col("doc_id").cast("string"))
    style = F.col("doc_id") % 7
    name = (
        F.when(style == 0, F.concat(F.lit("WhatsApp Chat with "), who, F.lit(".zip")))
        .when(style == 1, F.concat(F.lit("WhatsApp Chat with "), who, F.lit(" (2).zip")))
        .when(style == 2, F.concat(F.lit("Conversa do WhatsApp com "), who, F.lit(".txt")))
        .when(style == 3, F.concat(F.lit("Chat de WhatsApp con "), who, F.lit("_2026-03-12.TXT")))
        .when(style == 4, F.concat(F.lit("WhatsApp_Chat_"), F.translate(who, ".", "_"), F.lit(".txt")))
        .when(style == 5, F.lit("WhatsApp Chat.zip"))
        .otherwise(F.concat(who, F.lit(" - .txt")))
    )
    return docs.select("doc_id", X.clean_title(name).alias("title"))


@query
def unit_labels(spark, folder):
    docs = fx.table(spark, folder, "documents")
    named = docs.select("doc_id", F.concat("source", F.lit(".zip")).alias("name"))
    return S.unique_labels(named, "name", "doc_id").select("doc_id", "label")


@query
def expand_archives(spark, folder):
    """Real archives, built from the conversations inside Spark, then unpacked."""
    members = S.expand_archives(fx.archives(fx.simulated(spark, folder)))
    return members.select(
        "archive",
        "path",
        F.length("content").cast("bigint").alias("n_bytes"),
        F.sha1("content").alias("sha1"),
    )


@query
def archive_units(spark, folder):
    members = S.expand_archives(fx.archives(fx.simulated(spark, folder)))
    return S.archive_units(members).select("archive", "path", "hint_title", "n_transcripts")


@query
def archives_to_messages(spark, folder):
    """Archive bytes to messages: unpack, decode, parse."""
    members = S.expand_archives(fx.archives(fx.simulated(spark, folder)))
    texts = members.filter(S.is_transcript(F.col("path"))).select(
        F.xxhash64("archive").alias("unit_idx"),
        "archive",
        S.decode_transcript("content").alias("content"),
    )
    texts = materialize(texts, "decoded")
    parsed = P.parse_messages(texts, "dmy")
    return parsed.join(texts.select("unit_idx", "archive"), "unit_idx").select(
        "archive", "msg_no", "ts", "sender", "kind", "has_seconds",
        F.sha1(X.strip_right(F.col("text"))).alias("text_sha1"),
    )


# --- media -------------------------------------------------------------------------------------


def _resolved(spark, folder):
    v = fx.simulated(spark, folder)
    roots = fx.unit_roots(v)
    files = S.media_files(fx.media_members(v), roots.select("archive", "media_root"))
    return v, media.resolve_attachments(fx.raw_messages(v), roots, files)


def _resolved_messages(spark, folder):
    v, raw = _resolved(spark, folder)
    return v, dedup.merge_messages(raw, fx.unit_chat(v))


@query
def media_resolve(spark, folder):
    _, raw = _resolved(spark, folder)
    return raw.filter(F.col("attachment").isNotNull()).select(
        "unit_idx",
        "msg_no",
        F.col("attachment.path").alias("path"),
        F.col("attachment.size").alias("size"),
        F.nullif("attachment.content_hash", F.lit("")).alias("content_hash"),
    )


@query
def media_catalog(spark, folder):
    v, messages = _resolved_messages(spark, folder)
    catalog = media.media_catalog(messages)
    members = fx.media_members(v).select(
        F.concat_ws("!/", "archive", "path").alias("path"), "content"
    )
    return media.inline_sources(catalog, members).select(
        "media_key", "filename", "kind", "size", "n_messages", "status", "src"
    )


@query
def media_external_names(spark, folder):
    _, messages = _resolved_messages(spark, folder)
    renamed = F.col("attachment").withField("filename", F.lit("photo 1.jpg"))
    same = messages.withColumn("attachment", F.when(F.col("attachment").isNotNull(), renamed))
    named = same.filter(F.col("attachment.path").isNotNull())
    return media.media_catalog(named, mode="external").select("media_key", "name", "src")


@query
def media_report(spark, folder):
    _, messages = _resolved_messages(spark, folder)
    return media.media_report(messages, media.media_catalog(messages, max_inline_bytes=3))


# --- viewer queries ------------------------------------------------------------------------------


@query
def stored_messages(spark, folder):
    """The second to fourth message of a chat, read from the files that the manifest names."""
    messages, _ = _messages(spark, folder)
    place = f"{run_folder(spark)}/stored-{uuid.uuid4().hex}"
    T.write_messages(messages, place, buckets=8)
    return T.read_chat(spark, place, 7, 1, 3).select("chat_id", "msg_idx", "ts", "sender", "text")


@query
def search_messages(spark, folder):
    messages, unit_chat = _messages(spark, folder)
    return V.search(messages, _chats(messages, unit_chat), SEARCH_TERM)


@query
def search_accents(spark, folder):
    """Case and accents do not matter on either side; groups only."""
    messages, unit_chat = _messages(spark, folder)
    found = _search_index(spark, messages).search(_chats(messages, unit_chat), "LÉ", "group")
    return found.select("chat_rank", "chat_id", "msg_idx")


def _search_index(spark, messages):
    return SearchIndex.write(messages, f"{run_folder(spark)}/search-index-{uuid.uuid4().hex}", buckets=8)


@query
def search_indexed(spark, folder):
    """Postings of the grams in common, then the check on the folded texts."""
    messages, unit_chat = _messages(spark, folder)
    return _search_index(spark, messages).search(_chats(messages, unit_chat), SEARCH_TERM)


@query
def last_preview(spark, folder):
    messages, unit_chat = _messages(spark, folder)
    previews = V.last_previews(_with_owner(messages), _chats(messages, unit_chat))
    return previews.select("chat_id", "ts", "outgoing", "prefix", "body")


@query
def sender_share(spark, folder):
    return V.sender_share(_unordered(spark, folder)[0])


@query
def attachment_share(spark, folder):
    return V.attachment_share(_unordered(spark, folder)[0])


@query
def source_contribution(spark, folder):
    messages, unit_chat = _unordered(spark, folder)
    return V.source_contribution(messages, unit_chat, fx.units(fx.simulated(spark, folder)))


@query
def archive_sources(spark, folder):
    messages, _ = _unordered(spark, folder)
    return V.archive_sources(messages, fx.units(fx.simulated(spark, folder)))


@query
def chat_overview(spark, folder):
    return V.chat_overview(_unordered(spark, folder)[0])


@query
def archive_stats(spark, folder):
    messages, _ = _unordered(spark, folder)
    return V.archive_stats(messages, fx.units(fx.simulated(spark, folder)), fx.OWNER)


@query
def busiest_chats(spark, folder):
    messages, unit_chat = _messages(spark, folder)
    return V.busiest_chats(_chats(messages, unit_chat), 10)


@query
def latest_media_archive(spark, folder):
    messages, unit_chat = _messages(spark, folder)
    return V.latest_media(_linked(messages), _chats(messages, unit_chat), 300)


@query
def latest_media_per_chat(spark, folder):
    return V.latest_media_per_chat(_linked(_messages(spark, folder)[0]), limit=1)


@query
def media_ordinals(spark, folder):
    ordinals = V.media_ordinals(_linked(_messages(spark, folder)[0]))
    return ordinals.withColumn("viewable_idx", F.coalesce("viewable_idx", F.lit(-1).cast("bigint")))


def _event_messages(spark, folder) -> DataFrame:
    """Events as the messages of ten busy chats."""
    events = fx.table(spark, folder, "events").select(
        (F.col("user_id") % 10).alias("chat_id"),
        "event_id",
        "ts",
        F.when(F.col("event_type") != "error", F.col("user_id").cast("string")).alias("sender"),
        F.when(F.col("event_type") == "error", F.lit("system")).otherwise("text").alias("kind"),
    )
    return bucketed_index(
        events, ["chat_id"], X.epoch_minute(F.col("ts")), ["ts", "event_id"], "msg_idx"
    )


@query
def sender_runs(spark, folder):
    runs = V.sender_runs(_event_messages(spark, folder))
    return runs.withColumn("run_no", F.coalesce("run_no", F.lit(0).cast("bigint")))


@query
def day_labels(spark, folder):
    days = V.day_separators(_messages(spark, folder)[0], NOW)
    return days.withColumn("day", F.col("day").cast("string"))


@query
def chat_stamps(spark, folder):
    messages, _ = _unordered(spark, folder)
    ends = messages.groupBy("chat_id").agg(F.max("ts").alias("end_ts"))
    return V.chat_stamps(ends, NOW)


@query
def page_window(spark, folder):
    """The visible page of the ten busy chats, and how many messages are above it."""
    events = _event_messages(spark, folder)
    sizes = events.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n_messages"))
    starts = V.page_start(sizes, focus={3: 500}, steps_back=1)
    return V.page_window(events, starts).select("chat_id", "msg_idx", "event_id", "above")


@query
def deep_link(spark, folder):
    messages, unit_chat = _messages(spark, folder)
    chats = _chats(messages, unit_chat)
    return V.deep_link(messages, chats, "contact 7", 1).select("chat_id", "title", "ts", "sender")


@query
def payload_codes(spark, folder):
    """Messages as they are stored in documents: epoch, person number, kind code, sources."""
    messages, _ = _messages(spark, folder)
    encoded = K.encode_messages(_with_owner(messages), C.participants(messages))
    return encoded.select(
        "chat_id",
        "msg_idx",
        "item.t",
        F.coalesce("item.w", F.lit(-1).cast("bigint")).alias("w"),
        "item.k",
        "item.b",
        F.coalesce("item.o", F.lit(0)).alias("o"),
        joined("item.r").alias("r"),
    )


@query
def chat_documents(spark, folder):
    """The JSON pages of all chats, read back: messages by their place behind the earlier pages."""
    messages, unit_chat = _messages(spark, folder)
    pages = K.chat_documents(
        _with_owner(messages), _chats(messages, unit_chat), C.participants(messages), unit_chat, 400
    )
    schema = f"id string, title string, people array<string>, sources array<bigint>, msgs array<{K.MESSAGE_JSON}>"
    read = pages.select("chat_id", "page", F.from_json("document", schema).alias("d"))
    earlier = Window.partitionBy("chat_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    placed = read.withColumn("before", F.coalesce(F.sum(F.size("d.msgs")).over(earlier), F.lit(0)))
    return placed.select("chat_id", "before", "d.title", F.posexplode("d.msgs").alias("at", "item")).select(
        "chat_id",
        (F.col("before") + F.col("at")).alias("msg_idx"),
        "title",
        "item.t",
        F.coalesce("item.w", F.lit(-1).cast("bigint")).alias("w"),
        "item.k",
        "item.b",
        F.col("item.a.k").alias("file_kind"),
        F.nullif("item.a.n", F.lit("")).alias("file"),
        F.coalesce("item.o", F.lit(0)).alias("o"),
        joined("item.r").alias("r"),
    )


@query
def archive_documents(spark, folder):
    """The JSON pages above all chats, read back: labels of sources and notes by their place."""
    v = fx.simulated(spark, folder)
    messages, unit_chat = _messages(spark, folder)
    units = S.number_sources(fx.units(v).drop("source_idx"))
    few = _profiles(spark, folder)[1].filter("n_messages < 3")
    notes = few.select("unit_idx", F.lit("short").alias("code"), F.concat("title", F.lit(" is short")).alias("message"))
    pages = K.archive_documents(_chats(messages, unit_chat), units, notes, fx.OWNER, "All", 300)
    schema = f"title string, owner string, n_sources bigint, page bigint, sources array<string>, notes array<{K.NOTE_JSON}>"
    read = pages.select(F.from_json("document", schema).alias("d")).select("d.*")

    def entries(name: str, what: Column) -> DataFrame:
        earlier = Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
        placed = read.withColumn("before", F.coalesce(F.sum(F.size(name)).over(earlier), F.lit(0)))
        return placed.select("before", "title", "owner", "n_sources", F.posexplode(name).alias("at", "item")).select(
            F.lit(name).alias("part"), (F.col("before") + F.col("at")).alias("nth"), what.alias("entry"),
            "title", "owner", "n_sources",
        )

    return entries("sources", F.col("item")).unionByName(
        entries("notes", F.concat_ws("|", F.col("item.unit").cast("string"), "item.code", "item.message"))
    )


# --- text functions ----------------------------------------------------------------------------


@query
def links(spark, folder):
    """Links in page sources, each line of a page being a message."""
    pages = fx.table(spark, folder, "pages").select(
        F.col("page_id").alias("chat_id"),
        F.lit(0).alias("msg_idx"),
        F.concat_ws(" ", F.lit("see"), F.concat("url", F.lit("), www.example.org/a!")), "html").alias("text"),
    )
    return V.links(pages).select("chat_id", "nth", "url")


@query
def plain_text(spark, folder):
    docs = fx.table(spark, folder, "documents")
    style = F.col("doc_id") % 4
    marked = (
        F.when(style == 0, F.concat(F.lit("*bold text* and \ue000x\ue001\ue004a \ue002"), "text"))
        .when(style == 1, F.concat(F.lit("_slanted_, ~gone~ `*code*` "), "text"))
        .when(style == 2, F.concat(F.lit("```\nblock _x_```\n"), "text"))
        .otherwise(F.col("text"))
    )
    return docs.select("doc_id", D.plain_text(marked).alias("text"))


@query
def jumbo(spark, folder):
    rows = fx.table(spark, folder, "conversations")
    style = F.col("turn") % 4
    body = (
        F.when(style == 0, F.lit("\U0001f389\U0001f64f"))
        .when(style == 1, F.col("text"))
        .when(style == 2, F.repeat(F.lit("\U0001f44d"), F.lit(13)))
        .otherwise(F.lit("❤️ \U0001f1e7\U0001f1f7"))
    )
    return rows.select(
        "conv_id", "turn", D.is_jumbo(body).alias("jumbo"), D.is_jumbo(F.col("text")).alias("text_jumbo")
    )


@query
def stamps_and_sizes(spark, folder):
    events = fx.table(spark, folder, "events")
    size = F.floor(F.pow(F.col("value") + 1, F.lit(6.0))).cast("bigint")
    return events.select(
        "event_id",
        D.full_stamp(F.col("ts")).alias("stamp"),
        D.clock_text(F.col("ts")).alias("clock"),
        X.epoch_seconds(F.col("ts")).alias("epoch"),
        D.human_bytes(size).alias("size"),
    )
