from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

from threadlake.llm.piece_lattice import SPACE, PieceLattice
from threadlake.llm.segmentation import decoded, segmentations

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return PieceLattice(PATH)


def every(lattice, text):
    """All segmentations of an escaped text by recursion, best first."""
    if not text:
        return [(0.0, ())]
    out = []
    for n in range(1, min(len(text), lattice._longest) + 1):
        found = lattice._score.get(text[:n])
        if found is None and n == 1:
            found = (tuple(lattice._byte[b] for b in text[0].encode()), lattice._unknown)
        if found is not None:
            out += [(found[1] + score, (*found[0], *ids)) for score, ids in every(lattice, text[n:])]
    return sorted(out, reverse=True)


@pytest.mark.parametrize("text", ["the theme", "ab, the.", "a  b", "x\ny", "été", "日本 a", "banana band"])
def test_best_ones_against_all(lattice, text):
    want = every(lattice, SPACE + text.replace(" ", SPACE))
    got = lattice.encode(text, 6)
    assert [s for s, _, _ in got] == [s for s, _ in want[:6]]
    scores = {ids: s for s, ids in want}
    seen = [tuple(np.frombuffer(ids, "<u4").tolist()) for _, ids, _ in got]
    assert len(set(seen)) == len(seen) and [scores[i] for i in seen] == [s for s, _, _ in got]


def test_library_n_best(lattice):
    """The library's own search over the same pieces, where its 32-bit sums are exact."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    model = pb.ModelProto()
    with open(PATH, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    for text in ["the quick brown", "segmentation of words", "anonymous theory, again."]:
        score = lambda ids: sum(library.get_score(i) for i in ids)
        want = [score(ids) for ids in library.nbest_encode_as_ids(text, 5)]
        assert [s for s, _, _ in lattice.encode(text, 5)] == want


def test_documents_and_decoding(spark, documents):
    rows = segmentations(documents, PATH, 3)
    assert rows.filter("NOT round_trip").count() == 0
    assert rows.filter("rank = 1").count() == documents.count()
    back = decoded(rows.filter("rank < 3").select("doc_id", "ids"), PATH)
    assert back.join(documents.withColumnRenamed("text", "want"), "doc_id").filter("text <> want").count() == 0


def test_edge_rows(spark, edge_documents):
    rows = segmentations(edge_documents, PATH, 2).collect()
    assert all(r.round_trip for r in rows)
    assert sum(r.rank == 1 for r in rows) == edge_documents.count()
    assert [(r.rank, r.score, r.n_pieces) for r in rows if r.doc_id in (2, 3)] == [(1, 0.0, 0)] * 2
    for r in rows:
        assert len(r.ids) == 4 * r.n_pieces
    assert segmentations(edge_documents.limit(0), PATH).count() == 0


def test_space_sign(lattice):
    assert lattice.encode(f"a{SPACE}b", 1)[0][1:] == (lattice.encode("a b", 1)[0][1], True)


def test_texts_without_a_space(lattice):
    """Over a million characters in one word, and what is kept of it."""
    for text in ("ab7Xq+/Zk9" * 120_000, "語彙" * 300_000):
        first, *second = lattice.encode(text, 2)
        assert first[2] and all(same and score <= first[0] for score, _, same in second)
        assert lattice.decode(np.frombuffer(first[1], "<u4").tolist())[1:] == text.encode()


def test_a_forgetful_lattice_gives_the_same(lattice, monkeypatch):
    texts = ["The quick, brown fox.", None, "", "été à la plage", "the the the", "x\n\ny  z "] * 3
    want = [lattice.encode(t, 4) for t in texts]
    monkeypatch.setattr("threadlake.llm.piece_lattice.CACHE_BYTES", 300)
    monkeypatch.setattr("threadlake.llm.piece_lattice.SLICE", 5)
    other = PieceLattice(PATH)
    got = [r for k in range(0, len(texts), 4) for r in other.encode_all(texts[k : k + 4], 4)]
    assert got == want


def test_decoding_nothing_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, None, "x")], "doc_id bigint, ids binary, row string")
    assert [tuple(r) for r in decoded(frame, PATH).collect()] == [(1, None, "x", None)]
    assert decoded(frame.limit(0), PATH).collect() == []
