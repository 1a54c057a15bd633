from __future__ import annotations

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def edge_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing names."""
    long = "Ein langer Text, der sich wiederholt. " * 4000
    rows = [
        (1, "alpha beta gamma", "x", 1, 5),
        (1, "alpha beta gamma", "x", 1, 5),
        (2, None, None, None, None),
        (3, "", "y", 2, 6),
        (None, "no id at all", "z", 3, 7),
        (5, long, "y", 4, 8),
        (6, " \t\n ", "y", 5, 9),
        (7, "one", "y", 6, 10),
        (8, "One", "y", 7, 11),
        (9, "<|endoftext|> a<|endoftext|>été 日本 's 're n't x  y", "y", 8, 12),
        (10, "alpha beta gamma", "q", 9, 13),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, digest string, fp bigint, row bigint")
