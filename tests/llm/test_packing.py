from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from threadlake.llm.packing import GROUP_TOKENS, pack, pack_documents, step_groups
from threadlake.llm.word_ids import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs):
    library = Tokenizer.from_file(PATH)
    ids = [
        np.array(e.ids + [1], "<u4").tobytes()
        for e in library.encode_batch([t or "" for _, t in docs], add_special_tokens=False)
    ]
    whole = [(d, zlib.crc32(i), len(i) // 4) for (d, _), i in zip(docs, ids)]
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].sequence_length <= 2048 and at & (at - 1) == 0
    # Put the pieces of each document together again; equal ids of documents are told apart by their pieces.
    got = []
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for (doc, size), pieces in by_doc.items():
        total = sum(r.length for r in pieces)
        assert total % size == 0
        if total == size:
            joined = b"".join(r.ids for r in sorted(pieces, key=lambda r: r.start))
            got.append((doc, zlib.crc32(joined), size))
        else:
            got += [w for w in whole if w[0] == doc and w[2] == size]
    assert sorted(got, key=str) == sorted(whole, key=str)


def test_documents(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    rows = pack_documents(documents, PATH, with_ids=True).collect()
    check(rows, docs)
    longest = sum(r.length for r in rows if r.sequence_length == 2048)
    assert longest > 0.7 * sum(r.length for r in rows)


def test_edge_rows(spark, edge_documents):
    docs = [(r.doc_id, r.text) for r in edge_documents.collect()]
    check(pack_documents(edge_documents, PATH, with_ids=True).collect(), docs)
    assert pack_documents(edge_documents.limit(0), PATH).count() == 0


def test_pack_covers_every_id_once():
    rng = random.Random(2)
    for trial in range(200):
        lengths = [rng.choice((0, 1, 5, 255, 256, 257, 1024, 2047, 2048, 2049, 5000, rng.randint(1, 3000))) for _ in range(rng.randint(0, 40))]
        seen = [[] for _ in lengths]
        for sequence in pack(lengths):
            size = sum(n for _, _, n in sequence)
            assert 0 < size <= 2048 and size & (size - 1) == 0
            for doc, start, n in sequence:
                seen[doc].append((start, n))
        for pieces, length in zip(seen, lengths):
            at = 0
            for start, n in sorted(pieces):
                assert start == at and n > 0
                at += n
            assert at == length


def test_groups_are_balanced_over_the_table(spark, documents):
    """Also where tasks and batches are small."""
    rows = pack_documents(documents.repartition(7), PATH).collect()
    loads: dict[int, int] = {}
    for r in rows:
        loads[r.step_group] = loads.get(r.step_group, 0) + r.length
    total = sum(r.length for r in rows)
    groups = -(-total // GROUP_TOKENS)
    assert groups > 3 and sorted(loads) == list(range(groups))
    assert [loads[g] for g in range(groups - 1)] == [GROUP_TOKENS] * (groups - 1)
    assert len({(r.sequence_id, r.step_group) for r in rows}) == len({r.sequence_id for r in rows})


def test_step_groups_of_all_lengths(spark):
    sizes = [2048] * 20 + [1024] * 31 + [512] * 9 + [4, 2, 1]
    pieces = spark.createDataFrame([(i, 0, n) for i, n in enumerate(sizes)], "sequence_id bigint, `offset` bigint, sequence_length bigint")
    loads: dict[int, int] = {}
    for r in step_groups(pieces, 8192).collect():
        loads[r.step_group] = loads.get(r.step_group, 0) + r.sequence_length
    assert [loads[g] for g in sorted(loads)] == [8192] * (sum(sizes) // 8192) + [sum(sizes) % 8192]


def test_word_ids_are_the_library_s():
    library = Tokenizer.from_file(PATH)
    encoder = WordIds(PATH)
    rng = random.Random(4)
    parts = [" ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "word", "Word.", "A,", "J̌", "İ", "it's.", "...", "a..", "9.", "9.5",
             "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "İ", "Σ", "ß", "日本", "é", "É", ".", ",", "'LL"]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode(text) == want, repr(text)
