"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadlake.llm import (
    digest_index,
    html_text,
    licence_scan,
    merkle_manifest,
    packing,
    periodic_text,
    preference,
    quality,
    segmentation,
    simhash,
    text_fingerprints,
    token_counts,
    topk_search,
)
from threadlake.llm.rows import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, make: Callable[[SparkSession, DataFrame], DataFrame]) -> Query:
    """A query that applies ``make`` to a whole table."""
    return lambda spark, sf_dir: make(spark, table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_token_fst": _over("documents", token_counts.token_count_query),
    "op2_preference": preference.preference_query,
    "op3_nra_topk": _over("embeddings", topk_search.top_k_query),
    "op4_nbest_pieces": _over("documents", segmentation.segmentation_query),
    "op5_packing": _over("documents", packing.packing_query),
    "op6_digest_index": _over("documents", digest_index.exact_dedup_query),
    "op7_licence_dice": _over("documents", licence_scan.licence_query),
    "op8_rule_ensemble": quality.quality_query,
    "op9_simhash": _over("documents", simhash.near_dedup_query),
    "op10_html_crf": _over("pages", html_text.html_query),
    "op11_piecewise_hash": _over("documents", text_fingerprints.fingerprint_query),
    "op12_merkle_sweeps": _over("documents", merkle_manifest.manifest_query),
    "op13_lyndon_runs": _over("documents", periodic_text.periodic_query),
}

ORACLES: dict[str, str] = {
    "op2_preference": preference.ORACLE,
    "op3_nra_topk": topk_search.ORACLE,
    "op6_digest_index": digest_index.ORACLE,
    "op7_licence_dice": licence_scan.oracle_sql(),
    "op12_merkle_sweeps": merkle_manifest.ORACLE,
}
