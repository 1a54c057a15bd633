"""N-best piece segmentation of whole texts, and the way back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.llm.piece_lattice import piece_lattice

N_BEST = 4


def segmentations(
    docs: DataFrame, model: str, n: int = N_BEST, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, rank, score, n_pieces, ids, round_trip``: the ``n`` best of every text.

    ``model`` is the path of a SentencePiece file whose normaliser is the identity;
    its pieces and scores make the lattice.  ``ids`` are little-endian 32-bit numbers,
    ``round_trip`` tells whether decoding them gives the text.  A null or empty text
    has one segmentation, into no pieces; a text with fewer than ``n`` has as many
    rows.  Texts are taken whole, however long.  Equal scores are ranked the same way in every run.  Repeated rows are
    segmented each, null ids stay null, an empty table gives no rows; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = piece_lattice(model)
        for batch in batches:
            # A slice at a time, since the result has n times the ids of the texts.
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [
                    (i, rank, score, len(ids) // 4, ids, same)
                    for i, best in enumerate(lattice.encode_all(part.column(1).to_pylist(), n))
                    for rank, (score, ids, same) in enumerate(best, 1)
                ]
                place, rank, score, pieces, ids, same = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(place)),
                        pa.array(rank, pa.int32()),
                        pa.array(score, pa.float64()),
                        pa.array(pieces, pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array(same, pa.bool_()),
                    ],
                    ["doc_id", "rank", "score", "n_pieces", "ids", "round_trip"],
                )

    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")
    ).mapInArrow(run, "doc_id bigint, rank int, score double, n_pieces bigint, ids binary, round_trip boolean")


def decoded(segments: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """Add ``text``, the decoded ``ids``; null ids give a null text."""
    schema = T.StructType([*segments.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = piece_lattice(model)
        for batch in batches:
            place = batch.schema.get_field_index(ids)
            texts = [
                None if data is None else lattice.decode(memoryview(data).cast("I"))[1:].decode("utf-8", "replace")
                for data in batch.column(place).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return segments.mapInArrow(run, schema)


def segmentation_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return segmentations(docs, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", "rank", "score", "n_pieces", F.crc32("ids").alias("ids_crc32"), "round_trip"
    )
