"""Formatting and body-markup functions used by the archive queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.functions import patterns as p


def _one_decimal(amount: Column) -> Column:
    """A number with one decimal, ties to the even digit; ``format_string`` would round them up."""
    whole = F.floor(amount)
    tenths = F.rint((amount - whole) * 10).cast("int")
    return F.concat(F.when(tenths == 10, whole + 1).otherwise(whole).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def human_bytes(size: Column) -> Column:
    """A size as the reference's ``human_size`` prints it; null stays null."""
    kb, mb, gb = (size / F.lit(float(1024**i)) for i in (1, 2, 3))
    return (
        F.when(size < 1024, F.concat(size.cast("bigint").cast("string"), F.lit(" B")))
        .when(size < 1024**2, F.concat(_one_decimal(kb), F.lit(" KB")))
        .when(size < 1024**3, F.concat(_one_decimal(mb), F.lit(" MB")))
        .otherwise(F.concat(_one_decimal(gb), F.lit(" GB")))
    )


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy")


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def full_stamp(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy HH:mm:ss")


def day_label(ts: Column, now: dt.datetime) -> Column:
    """Today, Yesterday, a weekday within the last seven days, else the date."""
    day = ts.cast("date")
    today = F.lit(now.date())
    moment = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    recent = (ts <= moment) & (ts > moment - F.expr("INTERVAL 7 DAYS"))
    names = F.array(*[F.lit(name) for name in p.WEEKDAYS])
    return (
        F.when(day == today, F.lit("Today"))
        .when(day == F.date_sub(today, 1), F.lit("Yesterday"))
        .when(recent, F.element_at(names, F.dayofweek(day)))
        .otherwise(day_text(ts))
    )


def list_stamp(ts: Column, now: dt.datetime) -> Column:
    label = day_label(ts, now)
    return F.when(label == "Today", clock_text(ts)).otherwise(label)


def percent(part: Column, whole: Column) -> Column:
    """Whole percentage, halves rounded up."""
    return F.when(whole == 0, F.lit(0)).otherwise(
        F.floor(part * 100 / whole + F.lit(0.5))
    ).cast("bigint")


def links(text: Column) -> Column:
    """Every link of a body in order, with the scheme added to bare ``www.`` hosts."""
    found = F.regexp_extract_all(text, F.lit(p.URL), F.lit(1))
    return F.transform(
        found,
        lambda url: F.when(url.startswith("www."), F.concat(F.lit("https://"), url)).otherwise(url),
    )


#: Private-use delimiters around code and around links, and what stands for these in a body.
_CODE_START, _CODE_END, _LINK_START, _LINK_END, _ESCAPE = (chr(c) for c in range(0xE000, 0xE005))
_FENCES = _CODE_START + _CODE_END + _LINK_START + _LINK_END
#: The escape itself first, so that it can be undone last.
_ESCAPED = [(_ESCAPE, f"{_ESCAPE}e"), *((c, f"{_ESCAPE}{x}") for c, x in zip(_FENCES, "abcd"))]
_CODE = f"{_CODE_START}[^{_CODE_END}]*{_CODE_END}"
_LINK = f"{_LINK_START}[^{_LINK_END}]*{_LINK_END}"


def plain_text(text: Column) -> Column:
    """Body text without inline markup; code and links keep their characters.

    Code and links are fenced first.  A markup pair may enclose code but not a
    link, and nothing inside a fence is touched.
    """
    fenced = _replace_all(text, _ESCAPED)
    fenced = F.regexp_replace(
        fenced,
        f"{p.CODE_BLOCK}|{p.CODE_SPAN}",
        f"{_CODE_START}$1$2{_CODE_END}",
    )
    fenced = F.regexp_replace(fenced, p.URL, f"{_LINK_START}$1{_LINK_END}")
    for mark in p.INLINE_MARKS:
        fenced = _unmark(fenced, f"\\{mark}")
    # Most bodies hold no markup character at all.
    has_markup = text.rlike(f"[`{''.join(p.INLINE_MARKS)}]")
    bare = _replace_all(F.translate(fenced, _FENCES, ""), [(new, old) for old, new in reversed(_ESCAPED)])
    return F.when(has_markup, bare).otherwise(text)


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The replacements one after the other; bodies hardly ever hold any of the characters."""
    out = text
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(F.contains(text, F.lit(_ESCAPE)) | text.rlike(f"[{_FENCES}]"), out).otherwise(text)


def _unmark(text: Column, mark: str) -> Column:
    """Drop one kind of mark; every loop is over a plain class, so none recurses deeply."""
    run = rf"[^{mark}\n{_FENCES}]*"
    solid = rf"(?:{_CODE}|[^{p.VIEW_WS}{_FENCES}])"
    before = rf"(?<=\A|[{_LINK_END}{p.VIEW_WS}(\[])"
    after = rf"(?=\z|[{_LINK_START}{p.VIEW_WS}.,!?;:)\]])"
    inside = rf"({solid}(?:{run}(?:{_CODE}{run})*{solid})?)"
    any_start = rf"(?=[{_LINK_START}{_CODE_START}{mark}])"
    pattern = rf"{any_start}(?:({_LINK}|{_CODE})|{before}{mark}{inside}{mark}{after})"
    return F.regexp_replace(text, pattern, "$1$2")


def is_jumbo(text: Column) -> Column:
    """A short body made of emoji only, measured in UTF-16 units."""
    units = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    return (units > 0) & (units <= p.JUMBO_UNITS) & F.trim(text).rlike(p.EMOJI_ONLY)
