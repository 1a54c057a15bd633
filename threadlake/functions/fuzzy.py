"""Accent folding and similarity ratios.

Spark has no built-in twin for the similarity ratio, so it runs as a small
Arrow-batched helper.  Folding has a JVM form that is exact for every search
term except those made of characters that decompose into several letters (for
instance Hangul syllables); only such terms take the Arrow form.
"""

from __future__ import annotations

import difflib
import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.functions import patterns as p

# Workers get these functions by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_COMBINING = re.compile(p.COMBINING_MARKS)


def fold_text(text: str) -> str:
    """Lower case without combining marks, for plain Python strings."""
    return _COMBINING.sub("", unicodedata.normalize("NFD", text.lower()))


@lru_cache(maxsize=1)
def _fold_rules() -> tuple[str, str, frozenset[str]]:
    """Characters that fold to one other character, and the letters of the rest."""
    source, target, complex_letters = [], [], set()
    for code in range(0x80, 0x110000):
        char = chr(code)
        if 0xD800 <= code < 0xE000 or char.lower() != char or _COMBINING.match(char):
            continue
        folded = _COMBINING.sub("", unicodedata.normalize("NFD", char))
        if folded == char:
            continue
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        else:
            complex_letters.update(folded)
            complex_letters.add(char)
    return "".join(source), "".join(target), frozenset(complex_letters)


def folds_natively(needle: str) -> bool:
    """Whether the JVM form finds exactly the matches of ``needle``."""
    return not set(fold_text(needle)) & _fold_rules()[2]


def align_fold(text: Column) -> Column:
    """Lower case with accents removed, one character per original character."""
    source, target, _ = _fold_rules()
    # Lower-casing would make two characters of the dotted capital I.
    return F.translate(F.lower(F.translate(text, "\u0130", "i")), source, target)


def fold_native(text: Column) -> Column:
    return F.regexp_replace(align_fold(text), p.COMBINING_MARKS, "")


@F.pandas_udf(T.StringType())
def fold_arrow(text: pd.Series) -> pd.Series:
    return text.map(fold_text, na_action="ignore")


def fold(text: Column, needle: str) -> Column:
    """Folded text for matching against the folded ``needle``."""
    return fold_native(text) if folds_natively(needle) else fold_arrow(text)


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of characters in matching blocks, with ``right`` as the indexed side.

    The value is the same for every caller and every length of the texts.
    """
    matcher, indexed, ratios = difflib.SequenceMatcher(None, autojunk=False), None, []
    for a, b in zip(left, right):
        if b != indexed:
            matcher.set_seq2(b)
            indexed = b
        matcher.set_seq1(a)
        ratios.append(matcher.ratio())
    return pd.Series(ratios, dtype="float64")
