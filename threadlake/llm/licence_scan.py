"""Licence scan: Dice coefficient of word bigrams against licence templates.

A text is looked at as a whole, by line and by sentence.  Each such unit is
normalised to its words and compared as a set of word bigrams with every template
whose size allows the threshold: a Dice coefficient of t needs sizes within the
factors t / (2 - t) and (2 - t) / t.  The same bound says how many of a template's
bigrams a match must share, so a few anchor words, which stand in more of each template's
bigrams than a match can do without, must occur in every text that matches:
texts without an anchor word are not looked at further, nor are units without
a bigram of any template.

Everything is built-in column expressions in one pass over the scan, with no
shuffle; the templates are a constant of the plan.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.licence_texts import TEMPLATES

THRESHOLD = 0.8

#: Words that most English texts have.
COMMON = frozenset(
    "a all an and any are as at be by can copy for from in is it may must no not of on one or out see such that the "
    "their this to under use with without you your".split()
)

#: Where sentences end: punctuation and white space behind it, or a line break.
SENTENCE = r"(?<=[.!?])[ \t]+|\n"


def _words(text: str) -> list[str]:
    """The normal form of a template, as ``bigrams`` has it for columns."""
    return [w for w in re.split(r"[\W_]+", text.lower().replace("licence", "license")) if w]


def template_bigrams(templates: Sequence[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    out = []
    for name, text in sorted(templates):
        words = _words(text)
        out.append((name, list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))))
    return out


def anchor_words(shapes: Sequence[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which every text that reaches the threshold with a template has one.

    A match shares at least the part t / (2 - t) of the template's bigrams, so it
    is enough that the words touch all of the others and one more.  Words that
    are common in any text are taken last, else those that touch most.
    """
    low = threshold / (2 - threshold)
    open_ = []
    for _, pairs in shapes:
        needed = len(pairs) - math.ceil(low * len(pairs) - 1e-9) + 1
        open_.append(([set(p.split(" ")) for p in pairs], needed))
    chosen: list[str] = []
    while open_ := [(p, n) for p, n in open_ if n > 0 and p]:
        counts = Counter(w for pairs, _ in open_ for pair in pairs for w in pair)
        word = max(counts, key=lambda w: (w not in COMMON, not w.isdigit(), counts[w], w))
        chosen.append(word)
        open_ = [([p for p in pairs if word not in p], n - sum(word in p for p in pairs)) for pairs, n in open_]
    return sorted(chosen)


def bigrams(words: Column) -> Column:
    """The distinct neighbouring pairs of an array of words."""
    most = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(
        F.zip_with(F.slice(words, 1, most), F.slice(words, 2, most), lambda a, b: F.concat_ws(" ", a, b))
    )


def licence_matches(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, scope, place, licence, dice, n_bigrams``, one row per unit that matches.

    ``scope`` is ``document``, ``line`` or ``sentence`` and ``place`` the unit's number
    in the text from 0; lines and sentences that are the whole text are
    listed in each scope.  ``licence`` is that of the best template, the first in the
    order of names where several are equal.  A null or empty text, or one of
    less than two words, matches nothing.  Repeated rows match each, null ids stay
    null, an empty table gives no rows; other columns are not read.
    """
    shapes = template_bigrams(templates)
    every = sorted({b for _, pairs in shapes for b in pairs})
    low = threshold / (2 - threshold)

    def numbered(scope: str, parts: Column) -> Column:
        return F.transform(
            parts, lambda part, i: F.struct(F.lit(scope).alias("scope"), i.alias("place"), part.alias("part"))
        )

    lowered = F.replace(F.lower(F.col(text).cast("string")), F.lit("licence"), F.lit("license"))
    anchored = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(anchor_words(shapes, threshold))})(?![\p{{L}}\p{{N}}])"
    plain = docs.filter(lowered.rlike(anchored)).select(
        F.col(doc_id).cast("bigint").alias("doc_id"), lowered.alias("t")
    )
    units = plain.select(
        "doc_id",
        F.explode(
            F.concat(
                numbered("document", F.array("t")),
                numbered("line", F.split("t", "\n")),
                numbered("sentence", F.split("t", SENTENCE)),
            )
        ).alias("unit"),
    ).select("doc_id", "unit.*")
    # The row number is no part of the result: a column that is not a function of
    # the row keeps the filters below from being moved under, and so repeating, the
    # expressions they use.
    here = F.monotonically_increasing_id().alias("here")
    words = units.select(
        "doc_id", "scope", "place", here, F.filter(F.split("part", r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("words")
    )
    pairs = words.select("doc_id", "scope", "place", here, bigrams(F.col("words")).alias("pairs"))
    near = pairs.filter((F.col("here") >= 0) & F.exists("pairs", lambda b: b.isin(every)))
    size = F.size("pairs")

    def dice(place: int, name: str, pairs_of: list[str]) -> Column:
        most = len(pairs_of)
        shared = F.size(F.array_intersect("pairs", F.array(*[F.lit(b) for b in pairs_of])))
        # Sizes outside of the bounds cannot reach the threshold.
        fits = (size >= low * most) & (size <= most / low)
        return F.when(
            fits,
            F.struct(
                (2.0 * shared / (size + most)).alias("dice"), F.lit(-place).alias("order"), F.lit(name).alias("licence")
            ),
        )

    best = F.array_max(F.array(*[dice(i, name, p) for i, (name, p) in enumerate(shapes)]))
    return (
        near.select("doc_id", "scope", "place", "pairs", here, best.alias("best"))
        .filter((F.col("here") >= 0) & (F.col("best.dice") >= threshold))
        .select("doc_id", "scope", "place", "best.licence", "best.dice", size.alias("n_bigrams"))
    )


def licence_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return licence_matches(docs)


def oracle_sql(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The query as DuckDB SQL, with the templates' texts as values."""
    values = ", ".join(
        "({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(sorted(templates))
    )
    split = r"[x FOR x IN regexp_split_to_array({}, '[^\p{{L}}\p{{N}}]+') IF x <> '']"
    lowered = "replace(lower({}), 'licence', 'license')"
    pairs = "list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])"
    return f"""
WITH t AS (
  SELECT place AS template, licence, {split.format(lowered.format('text'))} AS w
  FROM (VALUES {values}) AS v(place, licence, text)
), tb AS (
  SELECT template, licence, {pairs} AS b FROM t
), d AS (
  SELECT doc_id, {lowered.format('text')} AS t
  FROM documents WHERE text IS NOT NULL
), u AS (
  SELECT doc_id, 'document' AS scope, 0 AS place, t AS part FROM d
  UNION ALL
  SELECT doc_id, 'line', unnest(range(len(string_split(t, chr(10))))), unnest(string_split(t, chr(10))) FROM d
  UNION ALL
  SELECT doc_id, 'sentence', unnest(range(len(s))), unnest(s)
  FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(t, '([.!?])[ \\t]+', '\\1' || chr(1), 'g'), '\\n', chr(1), 'g'), chr(1)) AS s FROM d)
), w AS (
  SELECT doc_id, scope, place, {split.format('part')} AS w FROM u
), b AS (
  SELECT doc_id, scope, CAST(place AS INTEGER) AS place, {pairs} AS b FROM w WHERE len(w) > 1
), m AS (
  SELECT doc_id, scope, b.place, licence, template, len(b.b) AS n_bigrams,
         2.0 * CAST(len(list_intersect(b.b, tb.b)) AS DOUBLE) / (len(b.b) + len(tb.b)) AS dice
  FROM b JOIN tb ON len(b.b) * (2 - {threshold}) >= {threshold} * len(tb.b)
                AND len(b.b) * {threshold} <= (2 - {threshold}) * len(tb.b)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, scope, place ORDER BY dice DESC, template) AS rank
  FROM m WHERE dice >= {threshold}
)
SELECT doc_id, scope, place, licence, dice, CAST(n_bigrams AS INTEGER) AS n_bigrams FROM r WHERE rank = 1
"""
