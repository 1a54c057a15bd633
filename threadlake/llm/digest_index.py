"""Exact deduplication against a persistent digest index.

The index is a Parquet table with a row per distinct text: the SHA-256 of its
bytes, the document that stays, and how many rows had the text when it was
added.  The table is bucketed and sorted by digest, so a delivery of new data is
compared with it by a sort-merge anti-join in which only the delivery's digests
move; what is new is then appended.  Texts themselves are never shuffled.

A hot text is one row after the map-side aggregation of its delivery.  When the
decisions go back to the rows, both sides of that join are ordinary shuffles, so
adaptive execution can split the partition of a hot digest.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.rows import fresh_path, keep_documents, text_digest
from threadlake.session import materialize


#: What the folder of an index is called, before the number of buckets.
PREFIX = "buckets="


class DigestIndex:
    """A digest table at a path; opening the same path again goes on with it.

    The number of ``buckets`` is kept with the index, as part of its folder's name: a new index has as many
    as the session has shuffle partitions, an old one those that it began with, whatever
    the session says, and asking for another number is an error.  The table's name comes
    from a hash of the whole path, so two paths never share one.  One writer at a
    time: an append is a committed Parquet job, but two running at once would both find
    their digests new.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark = spark
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        folder = system.makeQualified(folder)
        names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
        begun = [int(name.removeprefix(PREFIX)) for name in names if name.startswith(PREFIX)]
        if len(begun) > 1 or (begun and buckets not in (None, *begun)):
            raise ValueError(f"the index at {path} has {begun} buckets")
        self.buckets = begun[0] if begun else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = f"{folder.toString()}/{PREFIX}{self.buckets}"
        system.mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path))
        self.table = f"digest_index_{hashlib.sha256(self.path.encode()).hexdigest()[:32]}"
        quoted = self.path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} "
            "(digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
            f"LOCATION '{quoted}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, groups: DataFrame) -> DataFrame:
        """Append those of ``groups(digest, keep_id, group_size)`` that are new.

        ``groups`` has one row per digest.  Returns a row for each: the new ones as
        they are, the others as the index has them, told apart by ``new``.  They
        are written once, so they can be read after the index has grown.  Both
        joins sort-merge with the index where it lies; only ``groups`` moves.
        """
        known = self.rows().hint("merge")
        fresh = groups.join(known.select("digest"), "digest", "left_anti")
        held = known.join(groups.select("digest"), "digest", "left_semi")
        columns = ["digest", "keep_id", "group_size"]
        decided = materialize(
            fresh.select(*columns, F.lit(True).alias("new")).unionByName(
                held.select(*columns, F.lit(False).alias("new"))
            ),
            "decided-digests",
        )
        (
            decided.filter("new")
            .select(*columns)
            .repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
            .write.insertInto(self.table)
        )
        return decided


def dedup(
    docs: DataFrame,
    index: DigestIndex,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Decide each row of a delivery and add its new texts to the index.

    Returns ``doc_id, keep_id, group_size, kept, digest``, one row per input
    row.  Texts are equal when their bytes are; null counts as empty.  Of equal
    texts of a delivery the largest ``doc_id`` stays (null ids sort lowest); a
    text that the index held before stays with the document recorded then, and
    no row of the delivery is kept.  Texts are hashed whole, however long.  ``group_size`` is the number of rows the
    text had in the delivery that added it.  Rows that repeat both id and text
    are decided alike.  An empty table gives no rows; other columns are not read.
    """
    marks = materialize(
        docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_digest(text).alias("digest")),
        "digests",
    )
    groups = marks.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    decided = index.add(groups)
    # Two plain shuffles, so that Spark can split the partition of a hot digest.
    return marks.join(decided, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "digest",
    )


def exact_dedup_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All documents as the first delivery to a new index."""
    index = DigestIndex(spark, fresh_path(spark, "digest-index"))
    return dedup(docs, index).select(
        "doc_id",
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each text stays, with all its columns."""
    index = DigestIndex(spark, fresh_path(spark, "digest-index"))
    kept = dedup(docs, index).filter("kept").select("doc_id", "digest")
    return keep_documents(docs, kept)


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
