"""SimHash near-duplicates by a segment-popcount grid.

Fingerprints: each document's word shingles are hashed to 64 bits and the bits
that most shingles set make the fingerprint.

Linking fingerprints that differ in at most ``MAX_BITS`` = 3 bits: the 64 bits
are cut into 32 segments of two bits, and a fingerprint is embedded as the vector
of its segments' popcounts (0, 1 or 2 each).  Changing one bit changes one count by
one, so the Manhattan distance of two vectors is at most the Hamming distance of
the fingerprints.  Of two halves of 16 segments, one is then within distance
``MAX_BITS // 2`` = 1.  The counts of a half are a cell of a grid; every
fingerprint stands in its own cell of each half and looks from there into the
cells one step up (the other one of a pair does the step down).  Pairs
that meet must pass the Manhattan bound over all 32 segments, then the exact
Hamming distance.  A half's counts fall together for unrelated fingerprints
about once in five million, so candidates stay few; equal fingerprints are one
row before the grid, so groups of copies make no pairs at all, and the
fingerprints near one centre are bounded by geometry, not by the number of documents.

The fingerprints are computed in Python tasks over Arrow batches (a shingle is
a slice of bytes there); the embedding, grid, bound and check are column
expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.rows import text_digest
from threadlake.operators.components import star_components
from threadlake.session import materialize

MAX_BITS = 3
SHINGLE_WORDS = 3
SEED = 42

#: Hashes unpacked to bits at a time, which bounds memory for very long texts.
BLOCK = 1 << 14

#: The low bit of every two-bit segment.
LOW = 0x5555555555555555


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text as an unsigned number; 0 where it has no word.

    Words are what stands between ASCII white space, with A-Z lower-cased.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    stops = (ends - 1)[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        block = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])]
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    majority = set_bits * 2 > len(starts)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, digest, fp)`` of every row, ``fp`` as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter(
                (fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values.view(np.int64))],
                ["doc_id", "digest", "fp"],
            )

    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        text_digest(text).alias("digest"),
        F.col(text).cast("string").alias("text"),
    ).mapInArrow(run, "doc_id bigint, digest binary, fp bigint")


def _embed(fp: Column) -> Column:
    """The 32 segment popcounts, two bits each, packed into a long."""
    upper = F.shiftrightunsigned(fp, 1)
    one = fp.bitwiseXOR(upper).bitwiseAND(F.lit(LOW))
    two = fp.bitwiseAND(upper).bitwiseAND(F.lit(LOW))
    return one.bitwiseOR(F.shiftleft(two, 1))


def _manhattan(a: Column, b: Column) -> Column:
    """Sum of the differences of packed counts, each of which is 0, 1 or 2."""
    off = a.bitwiseXOR(b)
    low = off.bitwiseAND(F.lit(LOW))
    high = F.shiftrightunsigned(off, 1).bitwiseAND(F.lit(LOW))
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def near_pairs(prints: DataFrame, fp: str = "fp") -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints within ``MAX_BITS`` bits, each once or twice.

    ``prints`` has each fingerprint once.
    """
    own = F.col(fp)
    counts = _embed(own)
    halves = F.array(
        *[
            F.struct(
                F.lit(half).alias("half"),
                F.shiftrightunsigned(counts, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF)).alias("cell"),
            )
            for half in (0, 1)
        ]
    )
    stand = prints.select(own.alias("b"), F.explode(halves).alias("at")).select("b", "at.*")
    # A step up in one segment, where its count is below two.
    steps = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(30), F.lit(2)), lambda d: F.call_function("shiftleft", F.lit(1).cast("bigint"), d)),
        lambda step: F.col("at.cell").bitwiseAND(step * 2) == 0,
    )
    look = (
        prints.select(own.alias("a"), F.explode(halves).alias("at"))
        .select(
            "a",
            F.col("at.half").alias("half"),
            F.explode(
                F.concat(
                    F.array(F.lit(0).cast("bigint")),
                    steps,
                )
            ).alias("step"),
            F.col("at.cell").alias("cell"),
        )
        .select("a", "half", (F.col("cell") + F.col("step")).alias("cell"))
    )
    near = (
        (F.col("a") != F.col("b"))
        & (_manhattan(_embed(F.col("a")), _embed(F.col("b"))) <= MAX_BITS)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    )
    here = (look["half"] == stand["half"]) & (look["cell"] == stand["cell"])
    return look.join(stand, here & near).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, digest, fp, component_id`` of every row.

    ``component_id`` is the smallest id among all documents that links of at
    most three differing bits reach, itself included; ids that are null count
    only where a component has no other.  A null or blank text has fingerprint
    zero, a text of fewer than three words is one shingle, repeated rows are in
    one component, and an empty table gives no rows.  Other columns are not read.
    """
    marks = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    prints = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-prints")
    pairs = materialize(near_pairs(prints), "near-pairs")
    linked = star_components(pairs, "a", "b")
    roots = linked.select(F.col("root").alias("node"), "root").distinct()
    members = materialize(linked.unionByName(roots), "members")
    lowest = (
        members.join(prints, members["node"] == prints["fp"])
        .groupBy("root")
        .agg(F.min("first").alias("lowest"))
    )
    groups = members.join(lowest, "root").select(F.col("node").alias("fp"), "lowest")
    classes = materialize(
        prints.join(groups, "fp", "left").select(
            "fp", F.coalesce("lowest", "first").alias("component_id")
        ),
        "classes",
    )
    # Two plain shuffles, so that Spark can split the partition of a hot fingerprint.
    return marks.join(classes, "fp").select("doc_id", "digest", "fp", "component_id")


def near_dedup_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
