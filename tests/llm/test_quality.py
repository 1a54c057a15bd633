from __future__ import annotations

import zlib

import numpy as np
import pytest

from threadlake.llm.quality import STATISTICS, learn, quality_query, score, stage, statistics
from threadlake.llm.rule_ensemble import Ensemble, fit

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return learn(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = quality_query(spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_columns_score_like_the_model(spark, model, edge_documents):
    rows = statistics(edge_documents).select("row.doc_id", "statistics.*").toPandas()
    want = model.score(rows[list(STATISTICS)].to_numpy(float))
    got = score(edge_documents, model).select("row.doc_id", "score").toPandas()
    assert sorted(got["score"].round(9)) == sorted(np.round(want, 9))
    assert score(edge_documents.limit(0), model).count() == 0


def test_statistics(spark):
    frame = spark.createDataFrame([(1, "Ab ab ab!\n1,2 %"), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r["row"].doc_id: r.statistics for r in statistics(frame).collect()}
    s = got[1]
    assert s.distinct_share == 1.0 and s.repeat_share == 0.0
    assert (round(s.upper_share * 15, 6), round(s.symbol_share * 15, 6), round(s.digit_share * 15, 6)) == (1, 1, 2)
    assert got[2] == got[3] and got[2].log_chars == got[2].distinct_share == 0.0


def test_few_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, quality int")
    odd = spark.createDataFrame([(1, 7), (2, None), (None, 1), (3, 0), (3, 1)], "doc_id bigint, quality int")
    assert learn(docs, none).rules == () and learn(docs, none).intercept == 0
    assert learn(docs, one).rules == () and learn(docs, one).intercept > 1
    assert learn(docs, odd).rules == ()


def test_labels_of_fold_zero_are_not_read(spark):
    docs = spark.createDataFrame([(i, "abc") for i in range(300)], "doc_id bigint, text string")
    labels = [(i, 0 if zlib.crc32(str(i).encode()) % 5 == 0 else 1) for i in range(300)]
    assert learn(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).intercept > 4


def test_fit_finds_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 1] > 0.6) & (x[:, 3] <= 0.5)).astype(float)
    model = fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.98
    assert fit(np.zeros((0, 4)), np.zeros(0)) == Ensemble(0.0)
    assert fit(np.ones((50, 4)), np.r_[np.zeros(25), np.ones(25)]).score(np.ones((1, 4)))[0] == pytest.approx(0.5)


def test_stage_keeps_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = stage(spark, docs, FOLDER)
    assert out.columns == docs.columns
    accepted = {r.doc_id for r in quality_query(spark, FOLDER).filter("predicted = 1").collect()}
    assert {r.doc_id for r in out.collect()} == accepted
