"""Whose archive is it: the person who is in most chats that are not named after them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import patterns as p
from threadlake.functions import text as X
from threadlake.functions.fuzzy import similarity


def sender_scores(messages: DataFrame, first_titles: DataFrame) -> DataFrame:
    """Per sender: messages, chats, chats titled with the sender's name, first place.

    ``first_titles`` holds ``chat_id, first_title``: the title of a chat's first
    export, which is what the chat is called while the owner is still unknown.
    """
    per_chat = (
        messages.filter(F.coalesce(F.col("sender"), F.lit("")) != "")
        .groupBy("sender", "chat_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("msg_idx").alias("first_idx"))
    )
    titled = X.normalize_title(F.col("sender")) == X.normalize_title(F.col("first_title"))
    return (
        per_chat.join(first_titles, "chat_id")
        .groupBy("sender")
        .agg(
            F.sum("n").alias("messages"),
            F.count(F.lit(1)).alias("chats"),
            F.count_if(titled).alias("titled_as_other"),
            F.min(F.struct("chat_id", "first_idx")).alias("first_place"),
        )
    )


def detect_owner(scores: DataFrame, override: str | None = None) -> DataFrame:
    """One row with ``owner`` (null when nobody ever wrote a message)."""
    if override:
        return _named_owner(scores, override)
    rank = F.struct(
        F.col("chats") - F.col("titled_as_other"),
        F.col("messages"),
        -F.col("first_place.chat_id"),
        -F.col("first_place.first_idx"),
    )
    return scores.agg(F.max_by("sender", rank).alias("owner"))


def _named_owner(scores: DataFrame, override: str) -> DataFrame:
    """Exact caseless match, else the most similar name, else the name as given."""
    target = X.normalize_title(F.lit(override))
    name = X.normalize_title(F.col("sender"))
    rated = (
        scores.select("sender", "first_place", name.alias("name"), target.alias("target"))
        .withColumn("ratio", similarity("name", "target"))
        .filter((F.col("name") == F.col("target")) | (F.col("ratio") >= p.OWNER_NAME_RATIO))
    )
    rank = F.struct(
        (F.col("name") == F.col("target")).cast("int"),
        F.col("ratio"),
        F.col("name"),
        -F.col("first_place.chat_id"),
        -F.col("first_place.first_idx"),
    )
    best = rated.agg(F.max_by("sender", rank).alias("found"))
    everyone = scores.agg(F.count(F.lit(1)).alias("people"))
    # Both sides are global aggregates of exactly one row.
    joined = best.withColumn("one", F.lit(1)).join(everyone.withColumn("one", F.lit(1)), "one")
    return joined.select(
        F.when(F.col("people") > 0, F.coalesce("found", F.lit(override))).alias("owner")
    )


def mark_outgoing(messages: DataFrame, owner: str | None) -> DataFrame:
    mine = F.lit(False) if owner is None else F.coalesce(F.col("sender") == owner, F.lit(False))
    return messages.withColumn("outgoing", mine)
