"""Resolving attachments to files and cataloguing every file once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import patterns as p
from threadlake.functions import text as X
from threadlake.operators.ranking import dense_index, global_index

MODES = ("inline", "external", "none")


def resolve_attachments(raw: DataFrame, units: DataFrame, files: DataFrame) -> DataFrame:
    """Fill path, size and hash of attachments whose file is beside the transcript.

    ``units``: ``unit_idx, archive, media_root``.  Files match by caseless base
    name within the unit's folder; only named attachments take part in the join.
    """
    roots = units.select("unit_idx", "archive", "media_root")
    att = F.col("attachment")
    has_name = F.coalesce(
        att.isNotNull() & ~att["omitted"] & (F.coalesce(att["filename"], F.lit("")) != ""), F.lit(False)
    )
    placed = files.select(
        F.struct("archive", "media_root", "folded_name").alias("_place"),
        F.struct(
            F.concat_ws("!/", F.nullif("archive", F.lit("")), F.col("path")).alias("path"), "size", "content_hash"
        ).alias("_file"),
    )
    found = (
        raw.filter(has_name)
        .join(roots.select("unit_idx", F.col("archive").alias("_archive"), F.col("media_root").alias("_root")), "unit_idx", "left")
        .withColumn(
            "_place",
            F.struct(
                F.col("_archive").alias("archive"),
                F.col("_root").alias("media_root"),
                X.casefold(X.base_name(att["filename"])).alias("folded_name"),
            ),
        )
        .join(placed, "_place", "left")
    )
    filled = F.when(
        F.col("_file").isNotNull(),
        att.withField("path", F.col("_file.path"))
        .withField("size", F.col("_file.size"))
        .withField("content_hash", F.col("_file.content_hash")),
    ).otherwise(att)
    # Messages without a file stay where they are; only the named ones meet the files.
    return (
        found.withColumn("attachment", filled)
        .select(*raw.columns)
        .unionByName(raw.filter(~has_name))
    )


def attachment_rows(messages: DataFrame, chats: DataFrame | None = None) -> DataFrame:
    """One row per attachment with the key of its file and its place in the archive.

    ``chats`` supplies the list order of the chats; without it chats come by id.
    """
    rows = messages.filter(F.col("attachment").isNotNull())
    if chats is None:
        rows = rows.withColumn("chat_rank", F.col("chat_id"))
    else:
        rows = rows.join(chats.select("chat_id", "chat_rank"), "chat_id")
    att = F.col("attachment")
    usable = ~att["omitted"] & (F.coalesce(att["filename"], F.lit("")) != "")
    key = F.coalesce(F.nullif(att["content_hash"], F.lit("")), att["path"])
    return rows.select(
        "chat_id",
        "chat_rank",
        "msg_idx",
        "attachment",
        usable.alias("usable"),
        F.when(usable & att["path"].isNotNull(), key).alias("media_key"),
    )


def _safe_names(catalog: DataFrame) -> DataFrame:
    """Harmless unique file names: ``name.ext``, ``name_2.ext``, ..."""
    base = F.regexp_replace(X.base_name(F.col("filename")), p.UNSAFE_NAME, "_")
    base = F.when(base == "", F.lit("file")).otherwise(base)
    ordered = global_index(
        catalog.withColumn("_base", base), ["chat_rank", "msg_idx"], "media_no"
    ).withColumn("_folded", F.lower("_base"))
    numbered = dense_index(ordered, ["_folded"], "media_no", "_nth", start=1)
    dotted = F.contains("_base", F.lit("."))
    stem = F.when(dotted, F.regexp_replace("_base", r"\.[^.]*$", "")).otherwise(F.col("_base"))
    tail = F.when(
        dotted, F.concat(F.lit("."), F.substring_index("_base", ".", -1))
    ).otherwise("")
    again = F.concat(stem, F.lit("_"), F.col("_nth").cast("string"), tail)
    return numbered.withColumn(
        "name", F.when(F.col("_nth") > 1, again).otherwise(F.col("_base"))
    ).drop("_base", "_folded", "_nth")


def media_catalog(
    messages: DataFrame,
    chats: DataFrame | None = None,
    mode: str = "inline",
    max_inline_bytes: int | None = None,
    folder: str = "media",
) -> DataFrame:
    """One row per unique file that messages point at, named by its first message.

    ``status`` is what happens to the file: ``inlined``, ``copied`` or ``none``.  No file
    is left out: beyond ``max_inline_bytes``, where that is given, a file is
    copied under a name of its own instead of being inlined.
    """
    if mode not in MODES:
        raise ValueError(f"unknown media mode: {mode}")
    att = F.col("first.attachment")
    catalog = (
        attachment_rows(messages, chats)
        .filter(F.col("media_key").isNotNull())
        .groupBy("media_key")
        .agg(
            F.min_by(
                F.struct("chat_rank", "msg_idx", "attachment"), F.struct("chat_rank", "msg_idx")
            ).alias("first"),
            F.count(F.lit(1)).alias("n_messages"),
        )
        .select(
            "media_key",
            att["filename"].alias("filename"),
            att["kind"].alias("kind"),
            att["mime"].alias("mime"),
            att["size"].alias("size"),
            att["path"].alias("path"),
            "first.chat_rank",
            "first.msg_idx",
            "n_messages",
        )
    )
    copied = F.lit(mode == "external")
    if mode == "inline" and max_inline_bytes is not None:
        copied = F.col("size") > max_inline_bytes
    if mode == "external" or max_inline_bytes is not None:
        # Names are unique among all files, so they do not hang on the limit.
        catalog = _safe_names(catalog).drop("media_no")
    else:
        catalog = catalog.withColumn("name", F.col("filename"))
    status = F.when(copied, F.lit("copied")).otherwise("inlined")
    return catalog.select(
        *[c for c in catalog.columns if c not in ("chat_rank", "msg_idx", "name")],
        F.when(copied, F.col("name")).otherwise(F.col("filename")).alias("name"),
        (F.lit("none") if mode == "none" else status).alias("status"),
        F.when(copied, F.concat(F.lit(f"{folder}/"), "name")).otherwise("").alias("src"),
    )


def media_content(catalog: DataFrame, contents: DataFrame) -> DataFrame:
    """``media_key, name, size, content``: the bytes of every file, each once.

    ``contents`` is ``path, content``; a file in use at several paths is read at the
    catalogue's.  Without media (mode ``none``) there is nothing to keep.
    """
    wanted = catalog.filter(F.col("status") != "none").select("media_key", "name", "size", "path")
    return wanted.join(contents.select("path", "content"), "path").select(
        "media_key", "name", "size", "content"
    )


def inline_sources(catalog: DataFrame, contents: DataFrame) -> DataFrame:
    """Add the data URI of every inlined file; ``contents``: ``path, content``."""
    wanted = catalog.filter(F.col("status") == "inlined").select("media_key", "path", "mime")
    # Line breaks, where a setting makes base64 write them, are no part of a link.
    body = F.translate(F.base64("content"), "\r\n", "")
    uris = wanted.join(contents.select("path", "content"), "path").select(
        "media_key", F.concat(F.lit("data:"), "mime", F.lit(";base64,"), body).alias("_uri")
    )
    return (
        catalog.join(uris, "media_key", "left")
        .withColumn("src", F.coalesce("_uri", "src"))
        .drop("_uri")
    )


def link_sources(messages: DataFrame, catalog: DataFrame, embed: bool = False) -> DataFrame:
    """Write each attachment's link; omitted attachments become missing.

    An inlined file is linked as ``#key``, its row in the catalogue, so that its
    bytes exist once.  ``embed`` repeats the data URI in every message instead.
    """
    att = F.col("attachment")
    key = F.coalesce(F.nullif(att["content_hash"], F.lit("")), att["path"])
    linkable = F.coalesce(att.isNotNull() & ~att["omitted"] & att["path"].isNotNull(), F.lit(False))
    link = F.col("src")
    if not embed:
        inlined = F.col("status") == "inlined"
        link = F.when(inlined, F.concat(F.lit("#"), "media_key")).otherwise(link)
    links = catalog.select(F.col("media_key").alias("_key"), link.alias("_src"))
    unusable = att["omitted"] | (F.coalesce(att["filename"], F.lit("")) == "")

    def linked(rows: DataFrame, src: Column) -> DataFrame:
        kind = F.when(unusable, F.lit("missing")).otherwise(att["kind"])
        filled = F.when(att.isNotNull(), att.withField("src", src).withField("kind", kind))
        return rows.withColumn("attachment", filled).select(*messages.columns)

    # Messages without a file stay where they are; only the others meet the catalogue.
    found = messages.filter(linkable).withColumn("_key", key).join(links, "_key", "left")
    return linked(found, F.coalesce("_src", F.lit(""))).unionByName(
        linked(messages.filter(~linkable), F.lit(""))
    )


def media_report(messages: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: files inlined or copied once, messages without a usable file."""
    files = catalog.agg(
        F.count_if(F.col("status") == "inlined").alias("inlined"),
        F.count_if(F.col("status") == "copied").alias("copied"),
        F.coalesce(
            F.sum(F.when(F.col("status") == "inlined", F.floor(F.col("size") * 4 / 3))), F.lit(0)
        )
        .cast("bigint")
        .alias("bytes_embedded"),
        F.lit(1).alias("_one"),
    )
    missing = attachment_rows(messages).agg(
        F.count_if(F.col("media_key").isNull()).alias("missing"), F.lit(1).alias("_one")
    )
    # Two one-row aggregates side by side.
    return files.join(missing, "_one").select(
        "inlined", "copied", "missing", "bytes_embedded"
    )
