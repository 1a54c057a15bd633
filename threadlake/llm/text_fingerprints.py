"""Fingerprints of texts and of their edits, and how alike they are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.llm.piecewise_hash import fingerprint, likeness
from threadlake.session import materialize


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every row's whole text, without a shuffle.

    Null is an empty text, whose fingerprint has no pieces; equal texts have equal
    fingerprints.  Every row is a document of its own; null ids stay null, an empty
    table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            marks = pa.array([fingerprint(t.encode()) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), marks], ["doc_id", "n_chars", "fingerprint"]
            )

    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")
    ).mapInArrow(run, "doc_id bigint, n_chars bigint, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of ``following``."""
    size = len(text) // 4
    return text[: len(text) - size] + following[:size]


_RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_NAMES = [part.split()[0] for part in _RESULT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
#: The first and the last document of a range, which stand next to those of other ranges.
_BORDER = "first_id bigint, first_digest binary, first_text binary, last_id bigint, last_text binary"
_BORDER_NAMES = [part.split()[0] for part in _BORDER.split(", ")]
_BORDER_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]


def _compared(number: int | None, text: str, mark: str, following: str, next_mark: str) -> tuple:
    changed = edited(text, following)
    content = changed.encode()
    changed_mark = mark if changed == text else fingerprint(content)
    return (
        number,
        len(text),
        hashlib.sha256(content).hexdigest(),
        mark,
        changed_mark,
        likeness(mark, changed_mark),
        likeness(mark, next_mark),
    )


def _columns(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def neighbour_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edit, and their likeness; columns as in ``_RESULT``.

    The next document is the one with the next larger ``doc_id`` (null is the smallest; rows with one id
    follow each other by the SHA-256 of their texts), after the last comes the first, which is the
    document itself if it is the only one.  ``edited_sha256`` and ``edited_fingerprint`` are of the
    text ``edited`` makes of both.  ``near_edited`` and ``near_next`` are the likeness (0 to 1)
    of the text's fingerprint to that of its edit and of the next document.

    Documents are brought into order once, by ranges, with compressed texts; a range holds
    one text at a time, whole, however long, and only its border documents are looked at again.  A
    null text counts as empty.  Every row gives a row, also where it repeats; an empty table gives
    none; other columns are not read.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                    pa.array([squeeze(t) for t in texts], pa.binary()),
                ],
                ["doc_id", "digest", "packed"],
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names, types = [*_NAMES, *_BORDER_NAMES], [*_TYPES, *_BORDER_TYPES]
        nothing = (None,) * len(_BORDER_NAMES)
        first = last = None
        for batch in batches:
            rows = []
            for number, digest, packed in zip(*(c.to_pylist() for c in batch.columns)):
                content = unpack(packed)
                here = (number, content.decode(), fingerprint(content))
                if last is None:
                    first = (number, digest, packed)
                else:
                    rows.append(_compared(*last, *here[1:]) + nothing)
                last, last_packed = here, packed
            yield _columns(rows, names, types)
        if last is not None:
            yield _columns([(None,) * len(_NAMES) + first + (last[0], last_packed)], names, types)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for number, packed, following in zip(*(c.to_pylist() for c in batch.columns)):
                content, other = unpack(packed), unpack(following)
                rows.append(_compared(number, content.decode(), fingerprint(content), other.decode(), fingerprint(other)))
            yield _columns(rows, _NAMES, _TYPES)

    order = [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()]
    ranges = (
        docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
        .mapInArrow(pack, "doc_id bigint, digest binary, packed binary")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )
    done = materialize(ranges.mapInArrow(compare, f"{_RESULT}, {_BORDER}"), "fingerprints")

    # A row for each range: whose text follows its last one.  Texts stay out of the window.
    borders = done.filter(F.col("first_text").isNotNull())
    along = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_digest", "place")
    numbered = materialize(
        borders.select(F.monotonically_increasing_id().alias("place"), *_BORDER_NAMES), "fingerprint-borders"
    )
    places = numbered.select("place", "first_id", "first_digest")
    following = places.select(
        "place",
        F.coalesce(
            F.lead("place").over(along),
            F.first("place").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        ).alias("next_place"),
    )
    ends = (
        numbered.select("place", "last_id", "last_text")
        .join(following, "place")
        .join(numbered.select(F.col("place").alias("next_place"), "first_text"), "next_place")
        .select("last_id", "last_text", "first_text")
        .mapInArrow(close, _RESULT)
    )
    return done.filter(F.col("first_text").isNull()).select(*_NAMES).unionByName(ends)


def fingerprint_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return neighbour_fingerprints(docs)
