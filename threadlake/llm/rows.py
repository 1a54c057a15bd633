"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.session import run_folder


#: Where this package is installed or checked out.
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers on this machine find the package where the driver did, whatever their folder.
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that the whole cluster shares."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def text_digest(text: str = "text") -> Column:
    """SHA-256 of a text's UTF-8 bytes, 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))


def keep_documents(
    docs: DataFrame, kept: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` named by ``kept(doc_id, digest)``, one row for each.

    A null ``doc_id`` is a name like any other.  Rows that repeat both id and
    text are one document; of such rows the smallest in the order of the other
    columns' JSON stays.  The columns of ``docs`` go through as one struct, so
    none of them can clash with the names used here.
    """
    left = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(doc_id).alias("doc_id"),
        text_digest(text).alias("digest"),
    )
    right = kept.select(F.col("doc_id").alias("keep_doc"), F.col("digest").alias("keep_digest"))
    same = left["doc_id"].eqNullSafe(right["keep_doc"]) & (left["digest"] == right["keep_digest"])
    rest = F.to_json(F.struct(*[F.col("doc")[c] for c in docs.columns if c != text]))
    one = Window.partitionBy("doc_id", "digest").orderBy(rest)
    return (
        left.join(right, same, "left_semi")
        .withColumn("place", F.row_number().over(one))
        .filter("place = 1")
        .select("doc.*")
    )
