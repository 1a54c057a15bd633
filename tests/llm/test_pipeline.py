from __future__ import annotations

import corpus_pipeline
from threadlake.llm import quality
from threadlake.session import materialize

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "packing"]


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    accepted = {r.doc_id for r in quality.quality_query(spark, FOLDER).filter("predicted = 1").collect()}
    largest: dict[str, int] = {}
    for r in docs:
        if r.doc_id in accepted:
            largest[r.text or ""] = max(r.doc_id, largest.get(r.text or "", -1))
    left = sorted((i, shingles(t)) for t, i in largest.items())
    group = {i: i for i, _ in left}
    for i, a in left:
        for j, b in left:
            if j < i and group[i] != group[j] and 10 * len(a & b) >= 8 * len(a | b):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(group.values())
    tokens: dict[int, int] = {}
    for r in rows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert all(tokens[r.doc_id] == r.doc_tokens for r in rows)


def test_empty_and_odd_tables(spark, edge_documents):
    for docs in (edge_documents, edge_documents.limit(0)):
        here = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, here, FOLDER)
            if name != "packing":
                assert out.columns == docs.columns
            here = materialize(out, f"test-{name}")
        assert here.count() >= 0
