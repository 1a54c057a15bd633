"""Exports simulated from the given tables.

Every conversation is exported twice: side 0 with seconds and the first turns,
side 1 with minutes only and the later turns, so the two usually overlap.  All
rows of ``conversations`` take part.
"""

from __future__ import annotations

import io
import sys
import zipfile

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.operators.stitch import unit_profiles
from threadlake.schema import ATTACHMENT

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OWNER = "Owner Example"
START = "TIMESTAMP_NTZ'2026-01-01 00:00:00'"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: Column) -> Column:
    return column.cast("string")


def simulated(spark: SparkSession, folder: str) -> DataFrame:
    """One row per message of a simulated export."""
    conv, turn, side = F.col("conv_id"), F.col("turn"), F.col("side")
    sides = F.when(
        turn >= F.when(conv % 4 == 3, 5).otherwise(2),
        F.when(turn <= 4, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))),
    ).otherwise(F.array(F.lit(0)))
    rows = table(spark, folder, "conversations").withColumn("side", F.explode(sides))
    moment = F.expr(
        f"{START} + make_dt_interval(0, CAST(conv_id * 3 AS INT), 0, turn * 20)"
    )
    minute = F.expr(
        f"{START} + make_dt_interval(0, CAST(conv_id * 3 AS INT), 0, turn * 20 - (turn * 20) % 60)"
    )
    notice = F.col("role") == "system"
    media = ~notice & (turn % 3 == 1)
    omitted = media & (side == 0) & (conv % 2 == 0)
    sender = (
        F.when(notice, F.lit(None).cast("string"))
        .when(F.col("role") == "user", F.lit(OWNER))
        .when(
            conv % 5 == 0,
            F.concat(
                F.lit("Member "),
                text_of(conv % 7),
                F.when(turn % 4 >= 2, F.lit("-1")).otherwise("-0"),
            ),
        )
        .otherwise(F.concat(F.lit("Contact "), text_of(conv % 40)))
    )
    group_name = F.when((side == 1) & (conv % 3 == 1), F.lit("Weekend-Planning Group ")).otherwise(
        "Weekend Planning Group "
    )
    title = (
        F.when((side == 1) & (conv % 3 == 2), F.concat(F.lit("backup "), text_of(conv)))
        .when(conv % 5 == 0, F.concat(group_name, text_of(conv)))
        .otherwise(F.concat(F.lit("Contact "), text_of(conv % 40)))
    )
    return rows.select(
        (conv * 2 + side).alias("unit_idx"),
        F.concat(
            F.lit("conv"), text_of(conv), F.when(side == 0, F.lit("-a.zip")).otherwise("-b.zip")
        ).alias("label"),
        "conv_id",
        "side",
        turn.alias("msg_no"),
        F.col("text").alias("body"),
        F.when(side == 0, moment).otherwise(minute).alias("ts"),
        (side == 0).alias("has_seconds"),
        sender.alias("sender"),
        F.when(notice, F.lit("system")).when(media, F.lit("media")).otherwise("text").alias("kind"),
        omitted.alias("omitted"),
        F.when(
            media & ~omitted,
            F.concat(
                F.lit("0000000"),
                text_of(side),
                F.lit("-PHOTO-"),
                text_of(conv),
                F.lit("-"),
                text_of(turn),
                F.lit(".jpg"),
            ),
        ).alias("filename"),
        F.when(media, F.lit("")).otherwise(F.col("text")).alias("text"),
        title.alias("title"),
    )


def raw_messages(v: DataFrame) -> DataFrame:
    """The simulated exports as parsed messages."""
    attachment = F.struct(
        F.coalesce("filename", F.lit("")).alias("filename"),
        F.when(F.col("omitted"), F.lit("missing")).otherwise("image").alias("kind"),
        F.when(F.col("omitted"), F.lit("")).otherwise("image/jpeg").alias("mime"),
        F.lit(0).cast("bigint").alias("size"),
        F.lit(None).cast("string").alias("path"),
        F.lit("").alias("src"),
        F.lit("").alias("content_hash"),
        F.col("omitted").alias("omitted"),
    ).cast(ATTACHMENT)
    return v.select(
        "unit_idx",
        "msg_no",
        "ts",
        "sender",
        "text",
        "kind",
        F.when(F.col("kind") == "media", attachment).alias("attachment"),
        F.lit(False).alias("edited"),
        "has_seconds",
    )


def units(v: DataFrame) -> DataFrame:
    """One row per simulated export; its number is also its source id."""
    return v.groupBy("unit_idx").agg(
        F.first("unit_idx").alias("source_idx"),
        F.first("label").alias("label"),
        F.first("title").alias("title"),
        F.first("conv_id").alias("conv_id"),
    )


def unit_chat(v: DataFrame) -> DataFrame:
    """Exports with their conversation as the chat, for queries that need no stitching."""
    every = units(v)
    profiles = unit_profiles(every, raw_messages(v))
    return profiles.join(every.select("unit_idx", "source_idx", "conv_id"), "unit_idx").select(
        "unit_idx",
        "source_idx",
        F.col("conv_id").alias("chat_id"),
        "title",
        "placeholder",
        "groupish",
    )


# --- transcripts -------------------------------------------------------------------------


def rendered_lines(v: DataFrame) -> DataFrame:
    """``unit_idx, msg_no, line``: messages as a phone writes them."""
    seconds = F.concat(F.lit("["), F.date_format("ts", "dd/MM/yyyy, HH:mm:ss"), F.lit("] "))
    minutes = F.concat(F.date_format("ts", "dd/MM/yyyy, HH:mm"), F.lit(" - "))
    file = F.when(
        F.col("has_seconds"), F.concat(F.lit("<attached: "), "filename", F.lit(">"))
    ).otherwise(F.concat("filename", F.lit(" (file attached)")))
    said = (
        F.when(F.col("kind") != "media", F.col("text"))
        .when(F.col("omitted"), F.lit("<Media omitted>"))
        .otherwise(file)
    )
    mark = F.when(F.col("has_seconds"), F.lit("‎")).otherwise("")
    content = F.when(F.col("sender").isNull(), F.concat(mark, "text")).otherwise(
        F.concat("sender", F.lit(": "), said)
    )
    head = F.when(F.col("has_seconds"), seconds).otherwise(minutes)
    return v.select("unit_idx", "msg_no", F.concat(head, content).alias("line"))


def join_lines(lines: DataFrame) -> DataFrame:
    """Lines to one text per unit, for units of a bounded number of lines."""
    ordered = F.array_sort(F.collect_list(F.struct("msg_no", "line")))
    return lines.groupBy("unit_idx").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("content")
    )


def split_lines(lines: DataFrame, numbers: int) -> DataFrame:
    """``unit_idx, split_no, content``: the lines of so many message numbers in a row."""
    ordered = F.array_sort(F.collect_list(F.struct("msg_no", "line")))
    return lines.groupBy("unit_idx", F.floor(F.col("msg_no") / numbers).cast("bigint").alias("split_no")).agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("content")
    )


def split_transcripts(v: DataFrame) -> DataFrame:
    """Simulated transcripts in short splits, also cut within a message of several lines."""
    lines = rendered_lines(v).select("unit_idx", "msg_no", F.posexplode(F.split("line", "\n")).alias("at", "line"))
    numbered = lines.select(
        "unit_idx", (F.col("msg_no") * 2 + F.when(F.col("at") > 0, 1).otherwise(0)).alias("part"), "at", "line"
    )
    ordered = F.array_sort(F.collect_list(F.struct("at", "line")))
    return numbered.groupBy("unit_idx", F.col("part").cast("bigint").alias("split_no")).agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("content")
    )


def transcripts(v: DataFrame) -> DataFrame:
    return join_lines(rendered_lines(v))


#: Event numbers of a split of a simulated transcript.
EVENTS_OF_SPLIT = 20_000


def event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events as chat lines, a transcript per user, who writes dates in one of three orders."""
    events = table(spark, folder, "events")
    style = F.col("user_id") % 3
    stamp = (
        F.when(style == 0, F.date_format("ts", "dd/MM/yyyy, HH:mm:ss"))
        .when(style == 1, F.date_format("ts", "MM/dd/yyyy, hh:mm:ss a"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd, HH:mm:ss"))
    )
    return events.select(
        F.col("user_id").cast("bigint").alias("unit_idx"),
        F.col("event_id").alias("msg_no"),
        F.concat(F.lit("["), stamp, F.lit("] User: "), "event_type").alias("line"),
    )


# --- archives and media files ------------------------------------------------------------


@F.pandas_udf(T.BinaryType())
def zip_transcript(name: pd.Series, content: pd.Series) -> pd.Series:
    """An archive with one transcript and one picture, per row."""

    def pack(member: str, text: str) -> bytes:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(f"./{member}", text)
            archive.writestr("pictures\\one.jpg", member.encode())
        return buffer.getvalue()

    return pd.Series([pack(n, c) for n, c in zip(name, content)])


def archives(v: DataFrame) -> DataFrame:
    """``path, content``: one archive per simulated export."""
    labels = units(v).select("unit_idx", "label")
    texts = transcripts(v).join(labels, "unit_idx")
    name = F.when(F.col("unit_idx") % 2 == 0, F.lit("_chat.txt")).otherwise(
        F.concat(F.regexp_replace("label", r"\.zip$", ""), F.lit(".txt"))
    )
    return texts.select(
        F.concat(F.lit("/exports/"), "label").alias("path"),
        zip_transcript(name, F.col("content")).alias("content"),
    )


def media_members(v: DataFrame) -> DataFrame:
    """``archive, path, content`` of the named files; both exports hold the same bytes."""
    bytes_of = F.encode(F.concat(text_of(F.col("conv_id")), F.lit("-"), text_of(F.col("msg_no"))), "UTF-8")
    return v.filter(F.col("filename").isNotNull()).select(
        F.col("label").alias("archive"),
        F.concat(F.lit("media/"), "filename").alias("path"),
        bytes_of.alias("content"),
    )


def unit_roots(v: DataFrame) -> DataFrame:
    return units(v).select("unit_idx", F.col("label").alias("archive"), F.lit("").alias("media_root"))
