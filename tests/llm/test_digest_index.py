from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from threadlake.llm.digest_index import DigestIndex, dedup, exact_dedup_query, stage
from threadlake.llm.rows import fresh_path


def brute(rows):
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    out = []
    for r in rows:
        ids = groups[r.text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256((r.text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_edge_rows(spark, edge_documents):
    rows = [tuple(r) for r in exact_dedup_query(spark, edge_documents).collect()]
    assert sorted(rows, key=str) == brute(edge_documents.collect())
    assert exact_dedup_query(spark, edge_documents.limit(0)).count() == 0


def test_deliveries_and_reopening(spark):
    path = fresh_path(spark, "test-index")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id bigint, text string")
    second = spark.createDataFrame([(9, "a"), (4, "c"), (5, "c"), (6, None)], "doc_id bigint, text string")
    kept = lambda frame: sorted((r.doc_id, r.keep_id, r.kept) for r in frame.collect())
    assert kept(dedup(first, DigestIndex(spark, path, 3))) == [(1, 3, False), (2, 2, True), (3, 3, True)]
    spark.sql(f"DROP TABLE {DigestIndex(spark, path, 3).table}")
    again = DigestIndex(spark, path, 3)
    assert again.rows().count() == 2
    assert kept(dedup(second, again)) == [(4, 5, False), (5, 5, True), (6, 6, True), (9, 3, False)]
    assert again.rows().count() == 4


def test_the_index_keeps_its_buckets(spark):
    """Another number of shuffle partitions opens the same index, and none is asked of it in vain."""
    path = fresh_path(spark, "test-index")
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    kept = lambda: dedup(docs, DigestIndex(spark, path)).filter("kept").count()
    try:
        assert kept() == 2
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        assert kept() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError):
        DigestIndex(spark, path, 7)


def test_paths_that_look_alike(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    root = fresh_path(spark, "x" * 90)
    for path in (f"{root}/a-b", f"{root}/a_b", f"{root}/A_b", f"{root}/it's"):
        assert dedup(docs, DigestIndex(spark, path)).filter("kept").count() == 2
    for path in (f"{root}/a-b", f"{root}/a_b/", f"{root}/it's"):
        assert dedup(docs, DigestIndex(spark, path)).filter("kept").count() == 0


def test_index_is_not_shuffled(spark):
    """The index side of the joins is read in its buckets."""
    index = DigestIndex(spark, fresh_path(spark, "test-index"), 4)
    rows = spark.range(50).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.col("id").alias("keep_id"))
    index.add(rows.withColumn("group_size", F.lit(1).cast("bigint")))
    plan = rows.join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1


def test_stage_keeps_one_row_of_each_text(spark, edge_documents):
    out = stage(spark, edge_documents, "")
    assert out.columns == edge_documents.columns
    rows = out.collect()
    texts = [r.text or "" for r in rows]
    assert sorted(texts) == sorted({r.text or "" for r in edge_documents.collect()})
    assert {r.doc_id for r in rows} == {None, 3, 5, 6, 7, 8, 9, 10}
