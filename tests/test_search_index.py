"""The inverted index, against folding every text."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from threadlake.functions.fuzzy import fold_text
from threadlake.operators import views as V
from threadlake.operators.search_index import SearchIndex
from threadlake.session import run_folder

WORDS = ["été", "ÉTÉ", "Straße", "İstanbul", "한국어", "각", "éa", "naïve", "hello", "HELLO", "a", "lo", "日本", "x\0y", "👍🏽", "o"]


def message(chat, idx, text, filename=None):
    att = (filename, "image", "", 0, None, "", "", False) if filename else None
    return (chat, idx, None, "Ana", text, att)


SCHEMA = (
    "chat_id bigint, msg_idx bigint, ts timestamp_ntz, sender string, text string, "
    "attachment struct<filename:string,kind:string,mime:string,size:bigint,path:string,src:string,content_hash:string,omitted:boolean>"
)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [message(0, 0, ""), message(0, 1, None, "IMG été 1.jpg"), message(0, 2, "", "hello.txt"), message(0, 3, "o")]
    for chat in range(3):
        for i in range(10, 70):
            out.append(message(chat, i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 6)))))
    out.append(message(2, 99, "long " * 30_000 + "needle"))
    return out


@pytest.fixture(scope="module", params=[(64, 12, 8), (3, 5, 1)])
def made(request, spark, rows):
    messages = spark.createDataFrame(rows, SCHEMA)
    buckets, block_bits, part_bits = request.param
    folder = f"{run_folder(spark)}/index-{uuid.uuid4().hex}"
    return messages, SearchIndex.write(messages, folder, buckets, block_bits, part_bits)


def test_matches_against_every_text(spark, rows, made):
    _, index = made
    again = SearchIndex(spark, index.folder)
    needles = ["ete", "lo", "hello", "o h", "한", "ᄒ", "각", "istan", "日本", "o", "x\0", "needle", ".txt"]
    all_found, all_want = None, []
    for needle in map(fold_text, needles):
        want = sorted(
            (c, i) for c, i, _, _, text, att in rows if len(needle) >= 2 and needle in fold_text(text or (att[0] if att else ""))
        )
        found = again.matches(needle).select("chat_id", "msg_idx", F.lit(needle).alias("needle"))
        all_found = found if all_found is None else all_found.unionByName(found)
        all_want += [(c, i, needle) for c, i in want]
    assert sorted(map(tuple, all_found.collect())) == sorted(all_want) and len(all_want) > 200


def test_search_is_that_of_the_views(spark, made):
    messages, index = made
    chats = spark.createDataFrame(
        [(0, 0, "A", True), (1, 1, "B", False)], "chat_id bigint, chat_rank bigint, title string, is_group boolean"
    )
    for term, which, limit in (("ÉTE", "all", None), (" hello ", "group", None), ("lo", "media", None), ("ello", "all", 7), ("x", "all", None)):
        want = V.search(messages, chats, term, which, limit)
        got = index.search(chats, term, which, limit, messages)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_only_the_buckets_of_the_grams_are_read(made):
    _, index = made
    plan = index.candidates("hel")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(gram,hel)" in plan
    sizes = index.postings().select(F.size("docs").alias("n")).agg(F.max("n")).first()[0]
    assert sizes <= 1 << index.layout.block_bits


def test_no_messages(spark):
    folder = f"{run_folder(spark)}/index-{uuid.uuid4().hex}"
    index = SearchIndex.write(spark.createDataFrame([], SCHEMA), folder)
    assert index.matches("hello").collect() == [] and index.matches("he").collect() == []
