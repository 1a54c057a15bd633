from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from threadlake.llm import merkle_manifest
from threadlake.llm.merkle_manifest import leaf_digest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """The levels of nodes from the leaves to the one that is left."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([H(*low[i : i + 2]) for i in range(0, len(low), 2)])
    return levels


def siblings(levels, place):
    """``(sibling or None, whether it stands left)`` on the way up."""
    steps = []
    for level in levels[:-1]:
        other = place ^ 1
        steps.append((level[other] if other < len(level) else None, other < place))
        place //= 2
    return steps


def fold(leaf, steps):
    for other, is_left in steps:
        leaf = H(leaf) if other is None else H(other, leaf) if is_left else H(leaf, other)
    return leaf


def expected(rows):
    """``rows`` of doc_id, source, lang, n_chars, text."""
    groups = {}
    for doc_id, source, lang, n_chars, text in rows:
        leaf = leaf_of(doc_id, source, lang, n_chars, text)
        wrong = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        claimed = leaf_of(doc_id, source, lang, n_chars + 1, text) if wrong else leaf
        groups.setdefault("" if lang is None else "+" + lang, []).append((doc_id is not None, doc_id or 0, leaf, claimed))
    keys = sorted(groups, key=str.encode)
    for key in keys:
        groups[key].sort()
    trees = {key: tree([g[2] for g in groups[key]]) for key in keys}
    top = tree([trees[key][-1][0] for key in keys])
    out = []
    for number, key in enumerate(keys):
        for place, (has_id, doc_id, leaf, claimed) in enumerate(groups[key]):
            steps = siblings(trees[key], place) + siblings(top, number)
            folded = fold(claimed, steps)
            out.append(
                (
                    doc_id if has_id else None, leaf, trees[key][-1][0], top[-1][0],
                    H(*(s for s, _ in steps if s)), folded, folded == top[-1][0],
                )
            )
    return sorted(out, key=str)


def plain(rows):
    return sorted(map(tuple, rows), key=str)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.fixture(scope="module")
def edge_rows():
    rows = [(i, "web", "de", i, f"text {i}") for i in range(45)]
    rows += [(i, "web", f"l{i}", 3, "abc") for i in range(100, 109)]
    rows += [
        (7, "web", "de", 7, "text 7"),
        (7, "other", "de", 8, "of the same id"),
        (None, "web", "de", 1, "no id"),
        (None, None, None, None, None),
        (200, "", "", 0, ""),
        (201, None, "", None, ""),
        (202, "web", None, None, "x" * 300_000),
        (-3, "web", "é", 2, "Δοκιμή 日本"),
        (16, "web", None, 9223372036854775807, "many"),
    ]
    return rows


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_blocks_of_every_size_against_whole_trees(spark, edge_rows, levels, monkeypatch):
    monkeypatch.setattr(merkle_manifest.merkle_manifest, "__defaults__", (None, "lang", "doc_id", levels, False))
    docs = spark.createDataFrame(edge_rows, SCHEMA)
    rows = merkle_manifest.manifest_query(spark, docs).collect()
    assert plain(rows) == expected(edge_rows)
    assert {r.verified for r in rows} == {True, False}


def test_one_row_and_none(spark):
    one = [(5, "web", None, 4, "text")]
    rows = merkle_manifest.manifest_query(spark, spark.createDataFrame(one, SCHEMA)).collect()
    assert plain(rows) == expected(one)
    assert rows[0].leaf == rows[0].subroot == rows[0].root
    assert merkle_manifest.manifest_query(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_proofs_and_clashing_names(spark, edge_documents):
    """Any columns can make a leaf; grp, place, key and the like may be names of the table."""
    docs = edge_documents.withColumns({c: F.lit(1) for c in ("grp", "place", "key", "at", "first", "total", "block", "leaf")})
    leaf = leaf_digest(F.col("doc_id"), F.col("text"), F.col("fp"))
    rows = merkle_manifest.merkle_manifest(docs, leaf, group="digest", levels=1, with_proofs=True).collect()
    assert len(rows) == docs.count() and all(r.verified for r in rows)
    for row in rows:
        at = row.leaf
        for step in row.proof:
            at = H(at) if step == "-" else H(step[1:], at) if step[0] == "L" else H(at, step[1:])
        assert at == row.root
        assert row.proof_sha256 == H(*(s[1:] for s in row.proof))


def test_a_changed_field_is_found(spark, documents):
    rows = merkle_manifest.manifest_query(spark, documents).collect()
    wrong = {r.doc_id for r in documents.collect() if r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0}
    assert {r.doc_id for r in rows if not r.verified} == wrong and len(wrong) > 20
    assert plain(rows) == expected([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in documents.collect()])
