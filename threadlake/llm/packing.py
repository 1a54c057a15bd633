"""Hierarchical packing of documents into sequences of several lengths.

A document's tokens are cut into whole windows of ``WINDOW`` tokens, which are
sequences of their own, and a rest.  Rests are routed to the smallest context
size (tier) that holds them.  Tiers are packed from the longest to the
shortest: a rest opens a sequence, the gap behind it is filled with the longest
rests of shorter tiers that fit, and where none fits a rest is cut to
fill the gap exactly.  So every sequence is full; the last open one of a
block of documents is split along the powers of two in its length, which need no padding.
Finally the sequences of the whole table are dealt to step groups of equal token counts,
longest first.

A block is an Arrow batch, which Spark bounds by rows and bytes.  Blocks are packed
independently in the tasks that read them and written: no text and no id is shuffled, and a
lost task is computed again with the same sequence numbers.  The groups come from a second
step over the lengths of the sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.llm.word_ids import word_ids
from threadlake.operators.ranking import bucketed_index
from threadlake.session import materialize

WINDOW = 2048

#: Context sizes, longest first; each a power of two.
TIERS = (2048, 1024, 512, 256)

#: Tokens of a training step, a power of two.
GROUP_TOKENS = 16 * 2048

END_ID = 1

#: Sequence numbers of a partition start at its number shifted by so much.
PARTITION_SHIFT = 33

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, `offset` bigint, sequence_length bigint"
)

Piece = tuple[int, int, int]


class _Rests:
    """Rests of documents by length, with the set of lengths as bits of a number."""

    def __init__(self) -> None:
        self._by_length: dict[int, list[tuple[int, int]]] = {}
        self._lengths = 0

    def put(self, doc: int, start: int, length: int) -> None:
        if length:
            self._by_length.setdefault(length, []).append((doc, start))
            self._lengths |= 1 << length

    def take(self, length: int) -> Piece:
        stack = self._by_length[length]
        doc, start = stack.pop()
        if not stack:
            self._lengths ^= 1 << length
        return doc, start, length

    def longest(self, most: int) -> int:
        """The longest length up to ``most``, or 0."""
        return max(0, (self._lengths & ((2 << most) - 1)).bit_length() - 1)

    def shortest_over(self, least: int) -> int:
        """The shortest length over ``least``, or 0."""
        over = self._lengths >> (least + 1)
        return least + (over & -over).bit_length() if over else 0


def pack(lengths: list[int], window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences as lists of ``(document, start, length)``; every id in one piece.

    Each sequence is as long as a power of two, at most ``window``.
    """
    sequences: list[list[Piece]] = []
    rests = _Rests()
    for doc, length in enumerate(lengths):
        whole = length - length % window
        sequences += [[(doc, at, window)] for at in range(0, whole, window)]
        rests.put(doc, whole, length - whole)
    for place, size in enumerate(tiers):
        shorter = tiers[place + 1] if place + 1 < len(tiers) else 0
        while (opening := rests.longest(size)) > shorter:
            sequence, gap = [rests.take(opening)], size - opening
            while gap:
                # Whole rests of shorter tiers first; the shortest tier fills from itself.
                fits = rests.longest(min(gap, shorter or size))
                if fits:
                    sequence.append(rests.take(fits))
                    gap -= fits
                    continue
                longer = rests.shortest_over(gap) or rests.longest(gap)
                if not longer:
                    break
                doc, start, length = rests.take(longer)
                part = min(gap, length)
                sequence.append((doc, start, part))
                rests.put(doc, start + part, length - part)
                gap -= part
            sequences += [sequence] if not gap else _powers_of_two(sequence)
    return sequences


def _powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces cut into sequences along the powers of two in their total."""
    total = sum(length for _, _, length in pieces)
    queue, out = list(reversed(pieces)), []
    for bit in reversed(range(total.bit_length())):
        room = total & (1 << bit)
        if not room:
            continue
        sequence = []
        while room:
            doc, start, length = queue.pop()
            part = min(room, length)
            sequence.append((doc, start, part))
            if length > part:
                queue.append((doc, start + part, length - part))
            room -= part
        out.append(sequence)
    return out


def step_groups(pieces: DataFrame, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Add ``step_group`` to ``pieces``, which are read twice.

    Sequences are dealt out longest first.  Their lengths are powers of two, and so is
    ``group_tokens``, thus all groups have exactly so many tokens, but the last one, which
    has what is left.  Only a row per sequence is put in order, by length and number.
    """
    sequences = pieces.filter("`offset` = 0").select("sequence_id", "sequence_length")
    part = F.shiftright("sequence_id", PARTITION_SHIFT)
    placed = bucketed_index(sequences, ["sequence_length"], part, ["sequence_id"], "at")
    # At most a row for each power of two.
    longer = Window.orderBy(F.desc("sequence_length")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sequences.groupBy("sequence_length").agg(F.sum("sequence_length").alias("tokens"))
    begins = sums.select("sequence_length", F.coalesce(F.sum("tokens").over(longer), F.lit(0)).alias("begin"))
    token = F.col("begin") + F.col("at") * F.col("sequence_length")
    groups = placed.join(begins, "sequence_length").select(
        "sequence_id", F.floor(token / group_tokens).cast("bigint").alias("step_group")
    )
    return pieces.join(groups, "sequence_id").select(*pieces.columns, "step_group")


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Tokenize and pack; one row per piece of a document, as in ``SCHEMA``, with its ``step_group``.

    A document is the ids of its whole text by the ``tokenizers`` file at path ``tokenizer``,
    without special ones added, and then ``END_ID``; a null or empty text is that
    id alone.  ``start`` counts the document's ids before the piece, ``offset`` those before
    it in its sequence.  ``with_ids`` adds them as little-endian 32-bit numbers.
    Every row is a document of its own, also where id or text repeat or the id is null;
    an empty table gives no rows; texts are taken whole, however long.  Other columns are not read.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def block(batch: pa.RecordBatch, first: int) -> tuple[pa.RecordBatch, int]:
        encoder = word_ids(tokenizer)
        ids = [encoder.encode(t.as_py()) + end for t in batch.column(1)]
        counts = [len(i) // 4 for i in ids]
        sequences = pack(counts)
        sizes = [sum(p[2] for p in s) for s in sequences]
        rows: list[tuple[int, ...]] = []
        pieces: list[bytes] = []
        for number, sequence in enumerate(sequences):
            offset = 0
            for doc, start, length in sequence:
                part = ids[doc][4 * start : 4 * (start + length)]
                rows.append(
                    (doc, start, length, zlib.crc32(part), counts[doc], first + number, offset, sizes[number])
                )
                offset += length
                if with_ids:
                    pieces.append(part)
        table = np.array(rows, np.int64).reshape(-1, 8)
        columns = [batch.column(0).take(pa.array(table[:, 0]))] + [pa.array(table[:, c]) for c in range(1, 8)]
        if with_ids:
            columns.append(pa.array(pieces, pa.binary()))
        out = pa.RecordBatch.from_arrays(columns, names)
        return out, first + len(sequences)

    names = [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length",
    ] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << PARTITION_SHIFT
        for batch in batches:
            if batch.num_rows:
                out, sequence = block(batch, sequence)
                yield out

    pieces = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")
    ).mapInArrow(run, SCHEMA + ", ids binary" * with_ids)
    return step_groups(materialize(pieces, "packed-pieces"))


def packing_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of the packed sequences."""
    return packing_query(spark, docs)
