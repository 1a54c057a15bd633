"""Nested archive documents with short keys and dictionary-encoded references.

A chat is written as numbered pages.  Every page holds the next slice of the
chat's people, sources and messages, and joining the arrays of all pages in order gives the
chat.  Pages are balanced by weight: a slice ends where the bytes of its entries, summed up
along the chat, pass the next multiple of the page size.  So a slice is at most a page size
and one entry long, however long the chat is and however uneven its messages; where one
entry is longer than a page, page numbers skip.

The archive itself has pages of the same kind, with the labels of its sources and all notes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import text as X
from threadlake.operators.chats import archive_title
from threadlake.operators.ranking import dense_index, global_index, running_total

#: Bytes of messages, of people and of sources in a page.
PAGE_BYTES = 1 << 20

MESSAGE_JSON = (
    "struct<t:bigint,w:bigint,k:string,b:string,"
    "a:struct<n:string,k:string,m:string,s:string,z:bigint,o:int>,"
    "o:int,e:int,r:array<bigint>>"
)


def encode_messages(messages: DataFrame, people: DataFrame) -> DataFrame:
    """``chat_id, msg_idx, item``: empty and default fields are null and get dropped."""
    numbered = people.select("chat_id", "sender", "person_idx")
    att = F.col("attachment")

    def flag(column: str):
        return F.when(F.col(column), F.lit(1))

    attachment = F.when(
        att.isNotNull(),
        F.struct(
            att["filename"].alias("n"),
            att["kind"].alias("k"),
            att["mime"].alias("m"),
            F.nullif(att["src"], F.lit("")).alias("s"),
            F.nullif(att["size"], F.lit(0).cast("bigint")).alias("z"),
            flag("attachment.omitted").alias("o"),
        ),
    )
    item = F.struct(
        X.epoch_seconds(F.col("ts")).alias("t"),
        F.col("person_idx").alias("w"),
        F.nullif(X.kind_code(F.col("kind")), F.lit("t")).alias("k"),
        F.nullif("text", F.lit("")).alias("b"),
        attachment.alias("a"),
        flag("outgoing").alias("o"),
        flag("edited").alias("e"),
        F.col("sources").alias("r"),
    )
    return (
        messages.join(numbered, ["chat_id", "sender"], "left")
        .select("chat_id", "msg_idx", item.cast(MESSAGE_JSON).alias("item"))
    )


def _paged(rows: DataFrame, position: str, value: str, name: str, page_bytes: int) -> DataFrame:
    """``chat_id, page`` and the entries of each page, in order of a dense ``position``."""
    as_json: Column = F.to_json(F.struct(F.col(value).alias("v")), {"ignoreNullFields": "true"})
    weighed = rows.withColumn("_weight", F.octet_length(as_json).cast("bigint"))
    along = running_total(weighed, ["chat_id"], position, F.col("_weight"), "_upto")
    page = F.floor((F.col("_upto") - F.col("_weight")) / page_bytes).cast("bigint")
    entry = F.struct(F.col(position).alias("at"), F.col(value).alias("value"))
    return along.groupBy("chat_id", page.alias("page")).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["value"]).alias(name)
    )


def chat_documents(
    messages: DataFrame,
    chats: DataFrame,
    people: DataFrame,
    unit_chat: DataFrame,
    page_bytes: int = PAGE_BYTES,
) -> DataFrame:
    """``chat_rank, chat_id, page, document``: the archive as JSON pages."""
    msgs = encode_messages(messages, people)
    listed = dense_index(
        unit_chat.select("chat_id", "source_idx").distinct(), ["chat_id"], "source_idx", "nth"
    )
    pages = (
        _paged(msgs, "msg_idx", "item", "msgs", page_bytes)
        .join(_paged(people, "person_idx", "sender", "people", page_bytes), ["chat_id", "page"], "full")
        .join(_paged(listed, "nth", "source_idx", "sources", page_bytes), ["chat_id", "page"], "full")
    )
    none = F.array().cast("array<string>")
    document = F.struct(
        F.col("key").alias("id"),
        "title",
        F.col("is_group").alias("group"),
        "page",
        F.coalesce("people", none).alias("people"),
        F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"),
        F.coalesce("msgs", F.array().cast(f"array<{MESSAGE_JSON}>")).alias("msgs"),
    )
    return pages.join(
        chats.select("chat_id", "chat_rank", "key", "title", "is_group"), "chat_id"
    ).select(
        "chat_rank",
        "chat_id",
        "page",
        F.to_json(document, {"ignoreNullFields": "true"}).alias("document"),
    )


def archive_header(
    chats: DataFrame, units: DataFrame, owner: str | None, title: str | None = None
) -> DataFrame:
    """One row per archive: title, owner and number of chats and sources."""
    named = (
        archive_title(chats)
        if title is None
        else chats.agg(F.count(F.lit(1)).alias("n")).select(F.lit(title).alias("title"))
    )
    counts = units.agg(F.countDistinct("source_idx").alias("n_sources"), F.lit(1).alias("_one"))
    # Two one-row aggregates side by side.
    return named.withColumn("_one", F.lit(1)).join(counts, "_one").select(
        "title", F.lit(owner).cast("string").alias("owner"), "n_sources"
    )


NOTE_JSON = "struct<unit:bigint,code:string,message:string>"


def archive_documents(
    chats: DataFrame,
    units: DataFrame,
    notes: DataFrame,
    owner: str | None,
    title: str | None = None,
    page_bytes: int = PAGE_BYTES,
) -> DataFrame:
    """``page, document``: what stands above all chats, as JSON pages.

    Every page has title, owner and numbers; ``sources`` are labels by their number, and
    ``notes`` what a reader should know about the inputs, those of no export first.
    """
    whole = F.lit(0).cast("bigint").alias("chat_id")
    labels = units.groupBy("source_idx").agg(F.min("label").alias("label")).select(whole, "source_idx", "label")
    said = F.struct(F.col("unit_idx").alias("unit"), "code", "message").alias("note")
    order = [F.col("unit_idx").asc_nulls_first(), "code", "message"]
    placed = global_index(notes, order, "nth").select(whole, "nth", said)
    pages = _paged(labels, "source_idx", "label", "sources", page_bytes).join(
        _paged(placed, "nth", "note", "notes", page_bytes), ["chat_id", "page"], "full"
    )
    head = archive_header(chats, units, owner, title).withColumn("chat_id", whole)
    document = F.struct(
        "title",
        "owner",
        F.col("n_sources").alias("n_sources"),
        "page",
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
        F.coalesce("notes", F.array().cast(f"array<{NOTE_JSON}>")).alias("notes"),
    )
    # An archive without sources and notes still has a page.
    numbered = head.join(pages, "chat_id", "left").withColumn("page", F.coalesce("page", F.lit(0).cast("bigint")))
    return numbered.select("page", F.to_json(document, {"ignoreNullFields": "true"}).alias("document"))
