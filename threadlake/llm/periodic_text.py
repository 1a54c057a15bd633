"""Periodic stretches of words in texts: where they are, and the texts without the repeats."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.lyndon_runs import runs

#: A stretch counts from so many periods and so many words on.
EXPONENT, LEAST_WORDS = 4, 6


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document as the query takes them: a tenth of them end in a repeated stretch."""
    mark = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if mark % 10 or not words:
        return words
    n, g = len(words), mark // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def _word_ids(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)


def _collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds after its first period, joined by spaces."""
    if found:
        kept = np.ones(len(words), bool)
        for start, length, period in found:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def periodic_runs(
    docs: DataFrame,
    exponent: int = EXPONENT,
    least: int = LEAST_WORDS,
    doc_id: str = "doc_id",
    text: str = "text",
    plant: bool = False,
) -> DataFrame:
    """``doc_id, n_words, runs, best, collapsed`` of every row.

    Words are what stands between ASCII white space.  ``runs`` holds ``(start, length,
    period)`` of each stretch of words that repeats itself after ``period`` words, its
    smallest period, is at least ``least`` words and ``exponent`` periods long, and cannot
    be made longer; ordered by start, then period.  ``best`` is the one of the greatest
    length by period (ties: smallest start, then period), null if there is none.
    ``collapsed`` is the text with one period left of every run, words joined by a space.
    ``plant`` first repeats words at the end of every tenth document (see ``planted``).

    A text is taken whole, however long.  A null or blank text has no words and no run.
    Every row is a document of its own, also where id or text repeat or the id is null
    (which plants nothing); an empty table gives no rows; other columns are not read.
    """
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, all_runs, best, rest = [], [], [], []
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (content or b"").split()
                if plant:
                    words = planted(number, words)
                found = runs(_word_ids(words), exponent, least) if len(words) >= least else []
                counts.append(len(words))
                all_runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                best.append(top and dict(zip(("start", "length", "period"), top)))
                rest.append(_collapsed(words, found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(all_runs, pa.list_(triple)),
                    pa.array(best, triple),
                    pa.array(rest, pa.binary()),
                ],
                ["doc_id", "n_words", "runs", "best", "collapsed"],
            )

    one = "struct<start: bigint, length: bigint, period: bigint>"
    return (
        docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
        .mapInArrow(run, f"doc_id bigint, n_words bigint, runs array<{one}>, best {one}, collapsed binary")
        .withColumn("collapsed", F.col("collapsed").cast("string"))
    )


def periodic_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The runs of all documents, a tenth of which has a repeated stretch planted."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return periodic_runs(docs, plant=True).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
