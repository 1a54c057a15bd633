"""Scalar text functions as column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.functions import patterns as p

_DOTLESS_I, _STAND_IN = "ı", chr(0xE131)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(p.WHITESPACE))


def strip_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(p.WHITESPACE))


def _upper_then_lower(text: Column) -> Column:
    # The optimizer turns a bare lower(upper(x)) into lower(x), which is not the same.
    return F.lower(F.concat(F.upper(text), F.lit("")))


def casefold(text: Column) -> Column:
    """Caseless form: full upper-casing, then lower-casing, unifies ß/ss and σ/ς.

    The dotless i is shielded because upper-casing would turn it into a plain i.
    """
    shielded = F.translate(text, _DOTLESS_I, _STAND_IN)
    return F.when(
        F.contains(text, F.lit(_DOTLESS_I)),
        F.translate(_upper_then_lower(shielded), _STAND_IN, _DOTLESS_I),
    ).otherwise(_upper_then_lower(text))


def strip_marks(text: Column) -> Column:
    return F.regexp_replace(text, p.MARKS, "")


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, p.WHITESPACE_RUN, " ")


def normalize_text(text: Column) -> Column:
    """The form in which two bodies count as the same text."""
    # The look-ahead settles printable ASCII with one comparison.
    visible = F.regexp_replace(casefold(text), f"(?![ -~]){p.INVISIBLE}", "")
    return strip(collapse_whitespace(visible))


def normalize_title(title: Column) -> Column:
    return strip(collapse_whitespace(casefold(title)))


def is_placeholder_title(title: Column) -> Column:
    return title.rlike(p.PLACEHOLDER_TITLE)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def media_identity(filename: Column) -> Column:
    """File name without directory and without the export's own sequence number."""
    return casefold(F.regexp_replace(base_name(filename), p.SEQUENCE_PREFIX, ""))


def attachment_identity(filename: Column, content_hash: Column) -> Column:
    return F.coalesce(F.nullif(content_hash, F.lit("")), media_identity(filename))


def content_digest(content: Column) -> Column:
    """Digest of a whole file: equal only for equal bytes."""
    return F.sha2(content, 256)


def epoch_seconds(ts: Column) -> Column:
    """Wall-clock seconds since 1970, independent of the session time zone."""
    day = F.unix_date(ts.cast("date")).cast("bigint")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def epoch_minute(ts: Column) -> Column:
    day = F.unix_date(ts.cast("date")).cast("bigint")
    return day * 1440 + F.hour(ts) * 60 + F.minute(ts)


def sender_key(sender: Column) -> Column:
    """Caseless sender; notices without a sender share one reserved key."""
    return F.when(F.coalesce(sender, F.lit("")) == "", F.lit("\0system")).otherwise(
        casefold(sender)
    )


def body_hash(text: Column, attachment: Column) -> Column:
    """Hash of what was said: the attached file if one is named, else the text."""
    named = attachment.isNotNull() & ~F.coalesce(attachment["omitted"], F.lit(False))
    identity = attachment_identity(attachment["filename"], attachment["content_hash"])
    body = F.when(named, F.concat(F.lit("\1media:"), identity)).otherwise(normalize_text(text))
    return F.sha1(body.cast("binary"))


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Literal lookup table as one map literal."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def extension(filename: Column) -> Column:
    return F.when(
        F.contains(filename, F.lit(".")), F.lower(F.substring_index(filename, ".", -1))
    ).otherwise("")


def attachment_kind(filename: Column) -> Column:
    kinds = {ext: kind for ext, (kind, _) in p.MEDIA_TYPES.items()}
    kind = lookup(extension(filename), kinds, F.lit(p.DEFAULT_MEDIA_TYPE[0]))
    voice = (kind == "audio") & base_name(filename).rlike(p.VOICE_NAME)
    return F.when(voice, F.lit("voice")).otherwise(kind)


def attachment_mime(filename: Column) -> Column:
    mimes = {ext: mime for ext, (_, mime) in p.MEDIA_TYPES.items()}
    return lookup(extension(filename), mimes, F.lit(p.DEFAULT_MEDIA_TYPE[1]))


def kind_code(kind: Column) -> Column:
    return lookup(kind, p.KIND_CODES, F.lit("t"))


def kind_name(code: Column) -> Column:
    return lookup(code, {v: k for k, v in p.KIND_CODES.items()}, F.lit("text"))


def clean_title(name: Column) -> Column:
    """Conversation title from a file or archive name.

    Only the known suffixes are dropped, so a dotted name keeps its tail.
    """
    stem = F.regexp_replace(name, r"(?i)\.(?:zip|txt)$", "")
    bare = F.btrim(F.regexp_replace(stem, p.TITLE_PREFIX, ""), F.lit(" -_"))
    plain = F.regexp_replace(F.regexp_replace(bare, p.TITLE_COUNTER, ""), p.TITLE_DATE, "")
    title = strip(F.translate(plain, "_", " "))
    return F.when(title == "", F.lit(p.UNKNOWN_TITLE)).otherwise(title)
