"""Removing the overlap between exports while keeping where each message was seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions import text as X
from threadlake.operators.ranking import bucketed_index
from threadlake.schema import MESSAGE_COLUMNS


def with_keys(raw: DataFrame) -> DataFrame:
    """Add the identity of a message: minute, caseless sender, body hash.

    Minutes rather than seconds, because some exports only carry minutes.
    """
    return raw.withColumns(
        {
            "minute": X.epoch_minute(F.col("ts")),
            "who": X.sender_key(F.col("sender")),
            "body_hash": X.body_hash(F.col("text"), F.col("attachment")),
        }
    )


def assign_chats(raw: DataFrame, unit_chat: DataFrame) -> DataFrame:
    """Attach ``chat_id`` and the provenance id of the unit.

    ``unit_chat`` has one row per export: ``unit_idx, source_idx, chat_id``.
    """
    return raw.join(unit_chat.select("unit_idx", "source_idx", "chat_id"), "unit_idx")


def collapse_copies(messages: DataFrame) -> DataFrame:
    """One row per identity and chat; the richest copy survives.

    Richness prefers a resolved file, then seconds, then the longer text, and
    the earlier copy on ties.  Copies are merged before the shuffle, so a
    message that is present in very many exports stays one small group.
    """
    attachment = F.col("attachment")
    resolved = F.coalesce(attachment["path"].isNotNull(), F.lit(False))
    richness = F.struct(
        resolved.cast("int"),
        F.col("has_seconds").cast("int"),
        F.length("text"),
        -F.col("unit_idx"),
        -F.col("msg_no"),
    )
    keyed = messages if "body_hash" in messages.columns else with_keys(messages)
    return (
        keyed.groupBy("chat_id", "minute", "who", "body_hash")
        .agg(
            F.max_by(F.struct(*MESSAGE_COLUMNS), richness).alias("best"),
            F.min(F.struct("unit_idx", "msg_no")).alias("first"),
            F.array_sort(F.collect_set("source_idx")).alias("sources"),
        )
        .select(
            "chat_id",
            "minute",
            "who",
            "body_hash",
            "best.*",
            F.col("first.unit_idx").alias("first_unit"),
            F.col("first.msg_no").alias("first_no"),
            "sources",
        )
    )


def pair_placeholders(collapsed: DataFrame, require_other_source: bool = False) -> DataFrame:
    """Let real attachments absorb "media omitted" placeholders of the same slot.

    In every minute and sender the i-th placeholder belongs to the i-th real
    attachment, which takes over its sources.  With ``require_other_source`` a pair
    that some export has both of is left as it is.  One repartitioning by chat and
    minute serves both windows here and the ordering that follows.
    """
    omitted = F.coalesce(F.col("attachment.omitted"), F.lit(False))
    is_media = (F.col("kind") == "media") & F.col("attachment").isNotNull()
    role = F.when(~is_media, F.lit(0)).when(omitted, F.lit(1)).otherwise(F.lit(2))
    slot = ["chat_id", "minute", "who"]
    turn = Window.partitionBy(*slot, "_role").orderBy("first_unit", "first_no")
    pair = Window.partitionBy(*slot, "_turn")
    joined = F.col("_lost").isNotNull() & F.col("_found").isNotNull()
    if require_other_source:
        joined &= ~F.arrays_overlap("_lost", "_found")
    return (
        collapsed.repartition("chat_id", "minute")
        .withColumn("_role", role)
        # Other messages get a turn of their own kind and so never pair.
        .withColumn("_turn", F.row_number().over(turn) * F.when(is_media, 1).otherwise(-1))
        .withColumn("_lost", F.max(F.when(F.col("_role") == 1, F.col("sources"))).over(pair))
        .withColumn("_found", F.max(F.when(F.col("_role") == 2, F.col("sources"))).over(pair))
        .withColumn("_joined", F.coalesce(joined, F.lit(False)))
        .filter(~((F.col("_role") == 1) & F.col("_joined")))
        .withColumn(
            "sources",
            F.when(
                (F.col("_role") == 2) & F.col("_joined"),
                F.array_sort(F.array_union("sources", "_lost")),
            ).otherwise(F.col("sources")),
        )
        .drop("_role", "_turn", "_lost", "_found", "_joined")
    )


def order_messages(messages: DataFrame) -> DataFrame:
    """Give every message its place in its chat: by time, then first occurrence."""
    return bucketed_index(
        messages,
        ["chat_id"],
        F.col("minute"),
        ["ts", "first_unit", "first_no"],
        "msg_idx",
        settle=True,
    )


def merge_messages(
    raw: DataFrame, unit_chat: DataFrame, ranked: bool = True, require_other_source: bool = False
) -> DataFrame:
    """All of the above: export messages in, one ordered message table out.

    Without ``ranked`` the messages have no ``msg_idx`` and nothing is written on the
    way, so that aggregates over them read only the columns they use.
    """
    collapsed = collapse_copies(with_keys(assign_chats(raw, unit_chat)))
    paired = pair_placeholders(collapsed, require_other_source)
    return order_messages(paired) if ranked else paired


def merge_stats(messages: DataFrame) -> DataFrame:
    """Headline numbers of a merged archive, one row."""
    has_media = F.col("attachment").isNotNull()
    per_chat = messages.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.size("sources") > 1).alias("overlapping"),
        F.count_if(has_media).alias("media"),
        F.count_if(has_media & F.col("attachment.path").isNotNull()).alias("media_resolved"),
    )
    return per_chat.agg(
        F.count(F.lit(1)).alias("chats"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
            for c in ("messages", "overlapping", "media", "media_resolved")
        ],
    )
