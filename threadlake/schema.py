"""Explicit schemas of the archive tables."""

from __future__ import annotations

from pyspark.sql import types as T

ATTACHMENT = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("mime", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("src", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("omitted", T.BooleanType()),
    ]
)

#: One row per message of one export, before overlap is removed.
RAW_MESSAGE = T.StructType(
    [
        T.StructField("unit_idx", T.LongType()),
        T.StructField("msg_no", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("sender", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("attachment", ATTACHMENT),
        T.StructField("edited", T.BooleanType()),
        T.StructField("has_seconds", T.BooleanType()),
    ]
)

MESSAGE_COLUMNS = ["ts", "sender", "text", "kind", "attachment", "edited", "has_seconds"]

#: Members read from an archive or a folder.
MEMBER = "archive string, path string, content binary, error string"
