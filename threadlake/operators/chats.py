"""The chat table: titles, keys, order, participants and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions import text as X
from threadlake.operators.ranking import dense_index, global_index


def participants(messages: DataFrame) -> DataFrame:
    """``(chat_id, sender, n, person_idx)``, most active first, then by name."""
    counts = (
        messages.filter(F.coalesce(F.col("sender"), F.lit("")) != "")
        .groupBy("chat_id", "sender")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # One row per person and chat, so the window is over a roster, not messages.
    order = Window.partitionBy("chat_id").orderBy(F.desc("n"), "sender")
    return counts.withColumn("person_idx", (F.row_number().over(order) - 1).cast("bigint"))


def first_titles(unit_chat: DataFrame) -> DataFrame:
    return unit_chat.groupBy("chat_id").agg(F.min_by("title", "unit_idx").alias("first_title"))


def common_titles(unit_chat: DataFrame) -> DataFrame:
    """The most frequent real title of a chat's exports, the earlier one on ties."""
    return (
        unit_chat.filter(~F.col("placeholder"))
        .groupBy("chat_id", "title")
        .agg(F.count(F.lit(1)).alias("n"), F.min("unit_idx").alias("first_unit"))
        .groupBy("chat_id")
        .agg(F.max_by("title", F.struct(F.col("n"), -F.col("first_unit"))).alias("real_title"))
    )


def group_flags(unit_chat: DataFrame, people: DataFrame) -> DataFrame:
    """A chat is a group if an export looks like one or more than two people write."""
    looks = unit_chat.groupBy("chat_id").agg(F.max("groupish").alias("groupish"))
    writers = people.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n_people"))
    return looks.join(writers, "chat_id", "left").select(
        "chat_id",
        (F.col("groupish") | (F.coalesce("n_people", F.lit(0)) > 2)).alias("is_group"),
        F.coalesce("n_people", F.lit(0)).alias("n_people"),
    )


def other_people(people: DataFrame, owner: str | None, keep: int) -> DataFrame:
    """Per chat the first ``keep`` people besides the owner and how many there are."""
    others = people if owner is None else people.filter(F.col("sender") != owner)
    order = Window.partitionBy("chat_id").orderBy("person_idx")
    ranked = others.withColumn("_rn", F.row_number().over(order))
    named = F.when(F.col("_rn") <= keep, F.struct("_rn", "sender"))
    return ranked.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("n_others"),
        F.transform(F.array_sort(F.collect_list(named)), lambda x: x["sender"]).alias("others"),
    )


def build_chats(messages: DataFrame, unit_chat: DataFrame, owner: str | None) -> DataFrame:
    """One row per chat that has messages, most recent chat first (``chat_rank``)."""
    people = participants(messages)
    spans = messages.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
    )
    sources = unit_chat.groupBy("chat_id").agg(F.countDistinct("source_idx").alias("n_sources"))
    shown = F.array_join(F.slice("others", 1, 3), ", ")
    rest = F.when(F.col("n_others") > 3, F.concat(F.lit(" +"), F.col("n_others") - 3)).otherwise("")
    title = (
        F.when(F.col("real_title").isNotNull(), F.col("real_title"))
        .when(~F.col("is_group") & (F.col("n_others") == 1), F.element_at("others", 1))
        .when(F.col("n_others") > 0, F.concat(shown, rest))
        .otherwise(F.col("first_title"))
    )
    chats = (
        group_flags(unit_chat, people)
        .join(first_titles(unit_chat), "chat_id")
        .join(sources, "chat_id")
        .join(common_titles(unit_chat), "chat_id", "left")
        .join(other_people(people, owner, 3), "chat_id", "left")
        .join(spans, "chat_id", "left")
        .withColumn("n_others", F.coalesce("n_others", F.lit(0)))
        .withColumn("title", title)
        .select(
            "chat_id",
            "title",
            "is_group",
            "n_people",
            "n_sources",
            F.lit(owner).cast("string").alias("owner"),
            "start_ts",
            "end_ts",
            F.coalesce("n_messages", F.lit(0)).alias("n_messages"),
        )
    )
    ranked = global_index(chats, [F.desc_nulls_last("end_ts"), "chat_id"], "chat_rank")
    return number_keys(ranked).filter("n_messages > 0")


def number_keys(chats: DataFrame) -> DataFrame:
    """Chat keys from titles; a repeated key gets ``-2``, ``-3`` in list order."""
    plain = X.normalize_title(F.col("title"))
    named = chats.withColumn(
        "key",
        F.when(plain == "", F.concat(F.lit("chat-"), F.col("chat_id").cast("string"))).otherwise(plain),
    )
    numbered = dense_index(named, ["key"], "chat_rank", "_nth", start=1)
    suffix = F.when(F.col("_nth") > 1, F.concat(F.lit("-"), F.col("_nth").cast("string"))).otherwise("")
    return numbered.withColumn("key", F.concat("key", suffix)).drop("_nth")


def archive_title(chats: DataFrame, prefix: str = "WhatsApp archive") -> DataFrame:
    """The title of the only chat, or the number of conversations."""
    many = F.concat(F.lit(f"{prefix} · "), F.col("n").cast("string"), F.lit(" conversations"))
    return chats.agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("only")).select(
        F.when(F.col("n") == 1, F.col("only")).otherwise(many).alias("title")
    )
