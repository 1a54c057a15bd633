"""Token counts of whole texts by a tokenizer compiled to finite-state transducers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.token_fst import token_counter

#: Tokens from which a document is over the limit.
LIMIT = 1024


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    ``tokenizer`` is the path of a ``tokenizers`` file with a byte-level BPE
    vocabulary, which every executor compiles for itself.  A null or empty text
    has no bytes and no tokens; strings of special tokens inside a text are one
    token each, as the library has it by default.  Repeated rows are counted each,
    null ids stay null, an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            tokens = pa.array(counter.count(texts.to_pylist()))
            sizes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, tokens, pc.greater(tokens, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")
    ).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def token_count_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
