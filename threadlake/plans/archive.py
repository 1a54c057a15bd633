"""From export files, or from parsed messages, to a finished archive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators import chats as C
from threadlake.operators import dedup, media, owner, stitch, transcripts
from threadlake.session import materialize
from threadlake.sinks import documents as K
from threadlake.sources.exports import read_exports


@dataclass
class Archive:
    """Tables of a finished archive; ``owner`` is the detected or given name."""

    units: DataFrame
    unit_chat: DataFrame
    messages: DataFrame
    chats: DataFrame
    participants: DataFrame
    media_catalog: DataFrame
    media_content: DataFrame
    warnings: DataFrame
    owner: str | None

    def stats(self) -> DataFrame:
        return dedup.merge_stats(self.messages)

    def media_report(self) -> DataFrame:
        return media.media_report(self.messages, self.media_catalog)

    def documents(self, page_bytes: int = K.PAGE_BYTES, embed: bool = False) -> DataFrame:
        """JSON pages; ``embed`` repeats the bytes of inlined files in every message."""
        messages = self.messages
        if embed:
            messages = media.link_sources(messages, self.media_catalog, embed=True)
        return K.chat_documents(
            messages, self.chats, self.participants, self.unit_chat, page_bytes
        )

    def archive_documents(self, title: str | None = None, page_bytes: int = K.PAGE_BYTES) -> DataFrame:
        """JSON pages of the archive as a whole: sources and notes."""
        return K.archive_documents(self.chats, self.units, self.warnings, self.owner, title, page_bytes)

    def header(self, title: str | None = None) -> DataFrame:
        return K.archive_header(self.chats, self.units, self.owner, title)


def merge_exports(
    units: DataFrame,
    raw: DataFrame,
    mode: str = "full",
    owner_override: str | None = None,
) -> tuple[DataFrame, DataFrame, str | None]:
    """``(unit_chat, messages, owner)`` from units and their parsed messages.

    Only the owner's name, one value, comes to the driver.
    """
    grouped = stitch.stitch(units, raw, mode).unit_chat
    unit_chat = materialize(
        grouped.join(units.select("unit_idx", "source_idx"), "unit_idx"), "unit-chat"
    )
    messages = materialize(dedup.merge_messages(raw, unit_chat), "messages")
    scores = owner.sender_scores(messages, C.first_titles(unit_chat))
    name = owner.detect_owner(scores, owner_override).first()["owner"]
    return unit_chat, owner.mark_outgoing(messages, name), name


def build_archive(
    spark: SparkSession,
    paths: list[str],
    *,
    stitch_mode: str = "full",
    owner_override: str | None = None,
    date_order: str = "auto",
    media_mode: str = "inline",
    max_inline_bytes: int | None = None,
    media_folder: str = "media",
) -> Archive:
    """Read exports, merge them, resolve media and collect all warnings."""
    exports = read_exports(spark, paths)
    texts = materialize(exports.transcripts, "transcripts")
    parsed = transcripts.parse_splits(texts.withColumn("split_no", F.lit(0).cast("bigint")), date_order)
    raw = materialize(
        media.resolve_attachments(parsed.messages, exports.units, exports.files), "raw-messages"
    )
    units = materialize(transcripts.refine_titles(exports.units, raw), "titled-units")
    unit_chat, messages, name = merge_exports(units, raw, stitch_mode, owner_override)

    chats = materialize(C.build_chats(messages, unit_chat, name), "chats")
    catalog = media.media_catalog(messages, chats, media_mode, max_inline_bytes, media_folder)
    if media_mode == "inline":
        catalog = media.inline_sources(catalog, exports.contents)
    catalog = materialize(catalog, "media-catalog")
    linked = media.link_sources(messages, catalog)

    notes = exports.warnings.unionByName(transcripts.parse_warnings(parsed.counts, units, date_order))
    return Archive(
        units=units,
        unit_chat=unit_chat,
        messages=linked,
        chats=chats,
        participants=C.participants(messages),
        media_catalog=catalog,
        media_content=media.media_content(catalog, exports.contents),
        warnings=notes.select("unit_idx", "code", F.col("message")),
        owner=name,
    )
