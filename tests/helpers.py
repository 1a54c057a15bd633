from __future__ import annotations

import datetime as dt

from threadlake.schema import RAW_MESSAGE

MARK = "‎"


def attachment(filename="", kind="image", omitted=False, content_hash="", path=None, size=0, src=""):
    mime = "" if omitted else "image/jpeg"
    return (filename, "missing" if omitted else kind, mime, size, path, src, content_hash, omitted)


def row(unit, no, when, sender, text, att=None, seconds=None, kind=None):
    """A raw message; ``when`` is (day, hour, minute, second) of March 2026."""
    ts = dt.datetime(2026, 3, *when)
    kind = kind or ("media" if att else ("text" if sender else "system"))
    has_seconds = bool(when[3]) if seconds is None and len(when) > 3 else bool(seconds)
    return (unit, no, ts, sender, text, kind, att, False, has_seconds)


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW_MESSAGE)


def one_chat(spark, units):
    return spark.createDataFrame(
        [(u, u, 0) for u in units], "unit_idx bigint, source_idx bigint, chat_id bigint"
    )


def units_table(spark, titles):
    return spark.createDataFrame(
        [(i, i, f"{i}.zip", t) for i, t in enumerate(titles)],
        "unit_idx bigint, source_idx bigint, label string, title string",
    )
