"""Flat Parquet tables: the primary form of an archive on disk.

Beside the messages lies a manifest: which places of which chat each file holds, sorted by
chat.  Whoever wants a chat, or a few of its messages, reads from it the names of the
files to open, so nothing has to know how messages were dealt to files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Message files are grouped by chat, so that reading a chat opens few of them.
BUCKETS = 64

MANIFEST = "messages_manifest"

TABLES = ("units", "unit_chat", "messages", "chats", "participants", "media_catalog", "media_content", "warnings")


def write_archive(archive, folder: str, buckets: int = BUCKETS, mode: str = "errorifexists") -> None:
    for name in TABLES:
        table: DataFrame = getattr(archive, name)
        if name == "messages":
            write_messages(table, folder, buckets, mode)
        else:
            table.write.mode(mode).parquet(f"{folder}/{name}")


def write_messages(messages: DataFrame, folder: str, buckets: int = BUCKETS, mode: str = "errorifexists") -> None:
    """The messages of an archive and the manifest of their files."""
    # The salt spreads a dominant chat over several files of its bucket.
    salt = F.floor(F.col("msg_idx") / 100_000)
    bucketed = messages.withColumn("bucket", F.pmod(F.hash("chat_id"), F.lit(buckets)))
    writer = bucketed.repartition("bucket", "chat_id", salt).sortWithinPartitions("bucket", "chat_id", "msg_idx")
    writer.write.mode(mode).partitionBy("bucket").parquet(f"{folder}/messages")
    _write_manifest(messages.sparkSession, folder, mode)


def _write_manifest(spark: SparkSession, folder: str, mode: str) -> None:
    """A row for each chat in each file of messages, from the files as they are.

    Names are relative, so the archive may be moved.
    """
    stored = spark.read.parquet(f"{folder}/messages")
    file = F.regexp_extract("_metadata.file_path", "[^/]+/[^/]+$", 0)
    held = stored.groupBy("chat_id", file.alias("file")).agg(
        F.min("msg_idx").alias("first_idx"), F.max("msg_idx").alias("last_idx"), F.count(F.lit(1)).alias("n")
    )
    # Sorted, so that statistics of the manifest's own row groups rule most of them out.
    held.orderBy("chat_id", "first_idx").write.mode(mode).parquet(f"{folder}/{MANIFEST}")


def write_documents(documents: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """One JSON text line per page, in archive order."""
    documents.orderBy("chat_rank", "page").select("document").write.mode(mode).text(folder)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table: {name}")
    table = spark.read.parquet(f"{folder}/{name}")
    return table.drop("bucket")


def read_chat(
    spark: SparkSession, folder: str, chat_id: int, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Messages of one chat, from place ``first`` to ``last``; only files that hold some are opened."""
    held = spark.read.parquet(f"{folder}/{MANIFEST}").filter(F.col("chat_id") == chat_id)
    wanted = F.col("chat_id") == chat_id
    if first is not None:
        held, wanted = held.filter(F.col("last_idx") >= first), wanted & (F.col("msg_idx") >= first)
    if last is not None:
        held, wanted = held.filter(F.col("first_idx") <= last), wanted & (F.col("msg_idx") <= last)
    # The names of one chat's files, a name for each hundred thousand messages.
    files = [f"{folder}/messages/{r.file}" for r in held.select("file").distinct().collect()]
    whole = spark.read.parquet(f"{folder}/messages").drop("bucket")
    if not files:
        return whole.filter(F.lit(False))
    return spark.read.schema(whole.schema).parquet(*files).filter(wanted)


def read_link(spark: SparkSession, folder: str, key: str, index: int) -> DataFrame:
    """The message that a ``key/index`` link points at, with its chat's title."""
    chat = read_table(spark, folder, "chats").filter(F.col("key") == key).select("chat_id", "title").first()
    if chat is None:
        return read_chat(spark, folder, -1, index, index).withColumn("title", F.lit(None).cast("string"))
    return read_chat(spark, folder, chat.chat_id, index, index).withColumn("title", F.lit(chat.title))
