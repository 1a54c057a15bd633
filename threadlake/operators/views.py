"""Queries over a merged archive: filters, search, statistics, runs and pages.

``messages`` has ``chat_id, msg_idx`` (dense from 0 per chat) and the message
columns; ``chats`` has one row per chat with ``chat_rank`` as its list order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions import display as D
from threadlake.functions import fuzzy
from threadlake.functions import patterns as p
from threadlake.functions.text import epoch_seconds
from threadlake.operators.chats import other_people
from threadlake.operators.ranking import dense_index, running_total, with_previous

FILTERS = ("all", "group", "direct", "media")


def _has_attachment() -> Column:
    return F.col("attachment").isNotNull()


def _viewable() -> Column:
    att = F.col("attachment")
    return _has_attachment() & (F.coalesce(att["src"], F.lit("")) != "") & att["kind"].isin(
        *p.VIEWABLE_KINDS
    )


# --- chat list -------------------------------------------------------------------------


def filter_chats(chats: DataFrame, messages: DataFrame, which: str = "all") -> DataFrame:
    if which == "group":
        return chats.filter("is_group")
    if which == "direct":
        return chats.filter("NOT is_group")
    if which == "media":
        with_media = messages.filter(_has_attachment()).select("chat_id").distinct()
        return chats.join(with_media, "chat_id", "left_semi")
    if which != "all":
        raise ValueError(f"unknown filter: {which}")
    return chats


def last_previews(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """What the chat list shows of each chat's last message."""
    att = F.col("last.attachment")
    labels = F.create_map(*[F.lit(x) for item in p.PREVIEW_LABELS.items() for x in item])
    label = F.coalesce(
        F.try_element_at(labels, att["kind"]),
        F.nullif(att["filename"], F.lit("")),
        F.lit("Document"),
    )
    text = F.coalesce(F.col("last.text"), F.lit(""))
    body = (
        F.when((F.col("last.kind") == "media") & att.isNotNull() & (text == ""), label)
        .when(F.col("last.kind") == "deleted", F.lit("This message was deleted"))
        .otherwise(text)
    )
    prefix = F.when(
        F.col("is_group") & F.col("last.sender").isNotNull() & ~F.col("last.outgoing"),
        F.concat("last.sender", F.lit(": ")),
    ).otherwise("")
    last = messages.groupBy("chat_id").agg(
        F.max_by(F.struct("ts", "sender", "text", "kind", "attachment", "outgoing"), "msg_idx").alias(
            "last"
        )
    )
    return last.join(chats.select("chat_id", "chat_rank", "title", "is_group"), "chat_id").select(
        "chat_id",
        "chat_rank",
        "title",
        F.col("last.ts").alias("ts"),
        F.col("last.outgoing").alias("outgoing"),
        prefix.alias("prefix"),
        F.substring(F.regexp_replace(body, f"[{p.VIEW_WS}]+", " "), 1, p.PREVIEW_LENGTH).alias("body"),
    )


def chat_header(people: DataFrame, chats: DataFrame, owner: str | None) -> DataFrame:
    """Under a chat's title: the others of a group, or span and size of a direct chat."""
    others = other_people(people, owner, p.HEADER_NAMES)
    n = F.coalesce("n_others", F.lit(0))
    rest = F.when(n > p.HEADER_NAMES, F.concat(F.lit(" +"), n - p.HEADER_NAMES)).otherwise("")
    names = F.concat(F.coalesce(F.array_join("others", ", "), F.lit("")), rest)
    span = F.concat(
        D.day_text(F.col("start_ts")),
        F.lit(" – "),
        D.day_text(F.col("end_ts")),
        F.lit("  ·  "),
        F.format_number("n_messages", 0),
        F.lit(" messages"),
    )
    return chats.join(others, "chat_id", "left").select(
        "chat_id", F.when(F.col("is_group"), names).otherwise(span).alias("line")
    )


# --- search ----------------------------------------------------------------------------


def searched_text() -> Column:
    """What a search looks at: a message's text, or else the name of its file."""
    return F.coalesce(F.nullif("text", F.lit("")), F.col("attachment.filename"), F.lit(""))


def search(
    messages: DataFrame,
    chats: DataFrame,
    query: str,
    which: str = "all",
    limit: int | None = None,
) -> DataFrame:
    """Hits without regard to case and accents; all of them unless a ``limit`` is given.

    Reads and folds every text; ``search_index`` answers the same from a written index.  With a limit the first ones in chat order then message order.
    """
    needle = fuzzy.fold_text(query).strip()
    scope = filter_chats(chats, messages, which).select("chat_id", "chat_rank", "title")
    texts = messages.select("chat_id", "msg_idx", "ts", "sender", searched_text().alias("hay"))
    if len(needle) < 2:
        hits = texts.filter(F.lit(False))
    else:
        hits = texts.filter(F.contains(fuzzy.fold(F.col("hay"), needle), F.lit(needle)))
    found = hits.join(scope, "chat_id")
    if limit is not None:
        found = found.orderBy("chat_rank", "msg_idx").limit(limit)
    return found.select(
        "chat_rank",
        "chat_id",
        "title",
        "msg_idx",
        "ts",
        "sender",
        snippet(F.col("hay"), needle).alias("snippet"),
    )


def snippet(text: Column, needle: str) -> Column:
    """The hit with some text around it, marked; positions refer to the original text.

    The needle is looked for in an aligned form of the text, where every
    character still has its place and combining marks may follow any letter.
    """
    pattern = "".join(
        f"\\x{{{ord(c):x}}}{p.COMBINING_MARKS}*" for c in needle
    )
    aligned = fuzzy.align_fold(text)
    at = F.regexp_instr(aligned, F.lit(pattern))
    # One projection, so that sorting and limiting stay a single top-k step.
    length = F.length(F.regexp_extract(aligned, pattern, 0))
    # A term that only matches inside a decomposed letter has no aligned place; then
    # the text's beginning stands without a mark.
    plain = F.substring(text, 1, p.SNIPPET_BEFORE + p.SNIPPET_AFTER)
    begin = F.greatest(at - p.SNIPPET_BEFORE, F.lit(1))
    marked = F.concat(
        F.when(begin > 1, F.lit("…")).otherwise(""),
        F.substring(text, begin, at - begin),
        F.lit("«"),
        F.substring(text, at, length),
        F.lit("»"),
        F.substring(text, at + length, F.lit(p.SNIPPET_AFTER)),
    )
    return F.when(at > 0, marked).otherwise(plain)


# --- statistics ---------------------------------------------------------------------------


def sender_share(messages: DataFrame) -> DataFrame:
    """Messages per sender with the share of all the chat's messages."""
    counts = messages.groupBy("chat_id", "sender").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("chat_id").agg(F.sum("n").alias("total"))
    return (
        counts.filter(F.coalesce("sender", F.lit("")) != "")
        .join(totals, "chat_id")
        .select("chat_id", "sender", "n", D.percent(F.col("n"), F.col("total")).alias("pct"))
    )


def attachment_share(messages: DataFrame) -> DataFrame:
    counts = (
        messages.filter(_has_attachment())
        .groupBy("chat_id", F.col("attachment.kind").alias("kind"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("chat_id").agg(F.sum("n").alias("total"))
    return counts.join(totals, "chat_id").select(
        "chat_id", "kind", "n", D.percent(F.col("n"), F.col("total")).alias("pct")
    )


def source_contribution(messages: DataFrame, unit_chat: DataFrame, units: DataFrame) -> DataFrame:
    """Messages per chat and source export; sources that add nothing show 0."""
    counts = (
        messages.select("chat_id", F.explode("sources").alias("source_idx"))
        .groupBy("chat_id", "source_idx")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    labels = units.select("source_idx", "label").distinct()
    return (
        unit_chat.select("chat_id", "source_idx")
        .distinct()
        .join(counts, ["chat_id", "source_idx"], "left")
        .join(labels, "source_idx")
        .select("chat_id", "source_idx", "label", F.coalesce("n", F.lit(0)).alias("n"))
    )


def archive_sources(messages: DataFrame, units: DataFrame) -> DataFrame:
    """Messages per source export over the whole archive."""
    counts = (
        messages.select(F.explode("sources").alias("source_idx"))
        .groupBy("source_idx")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    labels = units.select("source_idx", "label").distinct()
    return labels.join(counts, "source_idx", "left").select(
        "source_idx", "label", F.coalesce("n", F.lit(0)).alias("n")
    )


def chat_overview(messages: DataFrame) -> DataFrame:
    facts = messages.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count_if(_has_attachment()).alias("n_attachments"),
        F.count_if(F.size("sources") > 1).alias("n_confirmed"),
    )
    seconds = epoch_seconds(F.col("last_ts")) - epoch_seconds(F.col("first_ts"))
    days = F.floor(seconds / 86400 + F.lit(0.5)) + 1
    return facts.select(
        "chat_id",
        "n_messages",
        "first_ts",
        "last_ts",
        F.greatest(days, F.lit(1)).cast("bigint").alias("span_days"),
        "n_attachments",
        "n_confirmed",
    )


def archive_stats(messages: DataFrame, units: DataFrame, owner: str | None) -> DataFrame:
    """One row over the whole archive."""
    totals = chat_overview(messages).agg(
        F.count(F.lit(1)).alias("conversations"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
            for c, name in (
                ("n_messages", "messages"),
                ("n_attachments", "attachments"),
                ("n_confirmed", "confirmed"),
            )
        ],
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.lit(1).alias("_one"),
    )
    sources = units.agg(F.countDistinct("source_idx").alias("sources"), F.lit(1).alias("_one"))
    # Two one-row aggregates side by side.
    return totals.join(sources, "_one").select(
        "conversations",
        "messages",
        "attachments",
        "sources",
        "confirmed",
        "first_ts",
        "last_ts",
        F.lit(owner if owner is not None else "unknown").alias("owner"),
    )


def busiest_chats(chats: DataFrame, limit: int) -> DataFrame:
    """The chats with most messages and their share of the archive."""
    total = chats.agg(F.sum("n_messages").alias("total"), F.lit(1).alias("_one"))
    top = chats.orderBy(F.desc("n_messages"), "chat_rank").limit(limit)
    return (
        top.withColumn("_one", F.lit(1))
        .join(total, "_one")
        .select(
            "chat_id",
            "title",
            "n_messages",
            D.percent(F.col("n_messages"), F.col("total")).alias("pct"),
        )
    )


# --- media ---------------------------------------------------------------------------------


def latest_media(messages: DataFrame, chats: DataFrame, limit: int) -> DataFrame:
    """Newest viewable media of the archive."""
    return (
        messages.filter(_viewable())
        .join(chats.select("chat_id", "chat_rank"), "chat_id")
        .orderBy(F.desc("ts"), "chat_rank", "msg_idx")
        .limit(limit)
        .select("chat_id", "msg_idx", "ts", "attachment.filename", "attachment.kind")
    )


def latest_media_per_chat(messages: DataFrame, limit: int) -> DataFrame:
    """Newest viewable media of every chat; only the top rows of a task are shuffled."""
    newest = Window.partitionBy("chat_id").orderBy(F.desc("msg_idx"))
    return (
        messages.filter(_viewable())
        .select("chat_id", "msg_idx", "ts", "attachment.filename", "attachment.kind")
        .withColumn("nth", F.row_number().over(newest).cast("bigint"))
        .filter(F.col("nth") <= limit)
    )


def media_ordinals(messages: DataFrame) -> DataFrame:
    """Place of each attachment among its chat's attachments, and among the viewable ones."""
    media = messages.filter(_has_attachment()).select(
        "chat_id", "msg_idx", _viewable().alias("viewable")
    )
    every = dense_index(media, ["chat_id"], "msg_idx", "media_idx")
    seen = running_total(
        every, ["chat_id"], "media_idx", F.col("viewable").cast("int"), "_seen"
    )
    return seen.select(
        "chat_id",
        "msg_idx",
        "media_idx",
        F.when(F.col("viewable"), F.col("_seen") - 1).alias("viewable_idx"),
    )


# --- runs, days, pages -----------------------------------------------------------------------


def sender_runs(messages: DataFrame, gap_seconds: int = p.RUN_GAP_SECONDS) -> DataFrame:
    """Mark where a run of bubbles by one sender starts, and number the runs.

    A run starts after a notice, on another day, for another sender, or after a
    pause.  Notices belong to no run.  Needs ``chat_id, msg_idx, ts, sender, kind``.
    """
    slim = messages.select(
        "chat_id",
        "msg_idx",
        "ts",
        "sender",
        "kind",
        epoch_seconds(F.col("ts")).alias("t"),
    )
    linked = with_previous(slim, ["chat_id"], "msg_idx", ["t", "sender", "kind", "ts"])
    starts = (
        F.col("prev_t").isNull()
        | (F.col("ts").cast("date") != F.col("prev_ts").cast("date"))
        | ~F.col("sender").eqNullSafe(F.col("prev_sender"))
        | (F.col("prev_kind") == "system")
        | (F.col("t") - F.col("prev_t") > gap_seconds)
    )
    spoken = F.col("kind") != "system"
    marked = linked.withColumn("run_start", spoken & starts)
    numbered = running_total(
        marked, ["chat_id"], "msg_idx", F.col("run_start").cast("int"), "_runs"
    )
    return numbered.select(
        "chat_id",
        "msg_idx",
        "sender",
        "run_start",
        F.when(spoken, F.col("_runs")).alias("run_no"),
    )


def run_lengths(runs: DataFrame) -> DataFrame:
    return (
        runs.filter(F.col("run_no").isNotNull())
        .groupBy("chat_id", "run_no")
        .agg(F.count(F.lit(1)).alias("n_messages"), F.min("msg_idx").alias("first_idx"))
    )


def day_separators(messages: DataFrame, now: dt.datetime) -> DataFrame:
    """First message of each day of each chat with the label shown above it.

    The order of a chat is by time, so its days are plain groups.
    """
    days = messages.groupBy("chat_id", F.col("ts").cast("date").alias("day")).agg(
        F.min("msg_idx").alias("first_idx"),
        F.min_by("ts", "msg_idx").alias("first_ts"),
        F.count(F.lit(1)).alias("n"),
    )
    return days.select(
        "chat_id", "day", "first_idx", "n", D.day_label(F.col("first_ts"), now).alias("label")
    )


def chat_stamps(chats: DataFrame, now: dt.datetime) -> DataFrame:
    return chats.select("chat_id", D.list_stamp(F.col("end_ts"), now).alias("stamp"))


def page_start(chats: DataFrame, focus: dict[int, int] | None = None, steps_back: int = 0) -> DataFrame:
    """``chat_id, from_idx, above``: where the visible page of each chat begins.

    Without a focus message a page is the end of the chat; with one it begins a
    third of a page before it.  Every step back shows one more page.
    """
    start = F.col("n_messages") - p.PAGE_SIZE
    if focus:
        pairs = F.create_map(*[F.lit(x) for item in focus.items() for x in item])
        focused = F.try_element_at(pairs, F.col("chat_id").cast("int"))
        start = F.coalesce(focused - p.PAGE_SIZE // 3, start)
    start = F.greatest(F.greatest(start, F.lit(0)) - steps_back * p.PAGE_SIZE, F.lit(0))
    return chats.select("chat_id", start.cast("bigint").alias("from_idx")).withColumn(
        "above", F.col("from_idx")
    )


def page_window(messages: DataFrame, starts: DataFrame) -> DataFrame:
    """Messages from the start of each chat's page to the end of the chat."""
    return messages.join(starts, "chat_id").filter(F.col("msg_idx") >= F.col("from_idx"))


def deep_link(messages: DataFrame, chats: DataFrame, key: str, index: int) -> DataFrame:
    """The message a ``key/index`` link points at."""
    chat = chats.filter(F.col("key") == key).select("chat_id", "title")
    return messages.filter(F.col("msg_idx") == index).join(chat, "chat_id")


def links(messages: DataFrame) -> DataFrame:
    """Every link in message bodies, in order within the message."""
    return messages.select(
        "chat_id", "msg_idx", F.posexplode(D.links(F.col("text"))).alias("nth", "url")
    )
