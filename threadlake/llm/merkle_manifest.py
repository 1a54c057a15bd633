"""A hash-tree manifest of documents: leaves per row, a tree per language, a tree over these."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.merkle_sweep import LEVELS, Forest, fold, siblings_digest
from threadlake.operators.ranking import global_index
from threadlake.session import materialize


def leaf_digest(*values: Column) -> Column:
    """SHA-256, 32 bytes, of values written one behind the other.

    A null is ``-``, anything else its length in UTF-8 bytes, a colon and the value.
    """
    written = [
        F.coalesce(F.concat(F.octet_length(v.cast("string")), F.lit(":"), v.cast("string")), F.lit("-")) for v in values
    ]
    return F.unhex(F.sha2(F.concat(*written), 256))


def _finish(with_proofs: bool):
    def finish(leaves: pa.Table, proofs: list[str]) -> pa.Table:
        claimed = leaves["claimed"].to_pylist()
        columns = {
            "grp": leaves["grp"],
            "doc_id": leaves["doc_id"],
            "leaf": leaves["digest"],
            "proof_sha256": pa.array([siblings_digest(p) for p in proofs], pa.string()),
            "folded_root": pa.array([fold(c.hex(), p) for c, p in zip(claimed, proofs)], pa.string()),
        }
        if with_proofs:
            columns["proof"] = pa.array([p.split() for p in proofs], pa.list_(pa.string()))
        return pa.table(columns)

    return finish


def merkle_manifest(
    docs: DataFrame,
    leaf: Column,
    claimed: Column | None = None,
    group: str = "lang",
    doc_id: str = "doc_id",
    levels: int = LEVELS,
    with_proofs: bool = False,
) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``leaf`` is the digest of a row.  The leaves of each ``group`` ascend by ``doc_id``
    (nulls first; rows with one id by leaf) and are hashed in pairs, a last one without a
    partner by itself, until one node is left, the ``subroot``.  The subroots, ordered by group
    (null first, then by UTF-8 bytes), are hashed alike to the ``root``.  ``proof_sha256``
    is the digest of a leaf's siblings on the way to the root; it has none at levels
    where it stands alone.  ``folded_root`` is what the siblings and ``claimed``, the leaf as
    someone has it, lead to; ``verified`` says whether that is the root.  Without ``claimed``
    or where it is null, the row's own leaf is folded.  ``with_proofs`` adds the siblings,
    each behind ``L`` or ``R`` for its side, with ``-`` for a level without one.

    Rows are narrow: a text is read once, for its leaf, and never moved, however long it is.  Rows that
    repeat are leaves of their own, null and empty values differ, an empty table gives no
    rows; columns that no argument names are not read.
    """
    rows = materialize(
        docs.select(
            # Null, the lowest, is the empty string.
            F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("key"),
            F.col(doc_id).cast("bigint").alias("doc_id"),
            leaf.alias("digest"),
            F.coalesce(claimed if claimed is not None else leaf, leaf).alias("claimed"),
        ),
        "leaves",
    )
    placed = global_index(rows, ["key", F.col("doc_id").asc_nulls_first(), "digest"], "at")
    keys = materialize(placed.groupBy("key").agg(F.min("at").alias("first")), "leaf-groups")
    groups = materialize(global_index(keys, ["key"], "grp").select("key", "grp", "first"), "leaf-group-numbers")
    leaves = placed.join(groups, "key").select("grp", (F.col("at") - F.col("first")).alias("place"), "doc_id", "digest", "claimed")

    trees = Forest(leaves, "subtree", levels)
    top = Forest(trees.tops.select(F.lit(0).cast("bigint").alias("grp"), F.col("grp").alias("place"), "digest"), "top", levels)
    over = top.proofs(top.tops.select("grp", F.lit("").alias("proof")))
    proved = trees.proofs(
        over.select(F.col("place").alias("grp"), "proof"),
        _finish(with_proofs),
        "grp bigint, doc_id bigint, leaf binary, proof_sha256 string, folded_root string" + ", proof array<string>" * with_proofs,
    )
    # One root, joined by the number of the only tree it can be of.
    roots = trees.tops.select("grp", F.lit(0).cast("bigint").alias("tree"), F.lower(F.hex("digest")).alias("subroot")).join(
        top.tops.select(F.col("grp").alias("tree"), F.lower(F.hex("digest")).alias("root")), "tree"
    )
    return proved.join(roots, "grp").select(
        "doc_id",
        F.lower(F.hex("leaf")).alias("leaf"),
        "subroot",
        "root",
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
        *["proof"] * with_proofs,
    )


def manifest_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All documents; a seventh of them is claimed with a wrong number of characters."""

    def leaf(n_chars: Column) -> Column:
        return leaf_digest(F.col("doc_id").cast("bigint"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    count = F.col("n_chars").cast("decimal(20, 0)")
    tampered = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % 7 == 0
    return merkle_manifest(docs, leaf(count), F.when(tampered, leaf(count + 1)))


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of a short ASCII string, bit by bit."""
    step = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
    fed = f"CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr({text}, 1 + i // 8, 1))::BIGINT) ELSE c END"
    return (
        "xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], range(8 * length({t}))), "
        "lambda c, i: {body}))"
    ).format(t=text, body=step.format(c=f"({fed})"))


def _written(value: str) -> str:
    return f"coalesce(octet_length(encode({value}))::VARCHAR || ':' || {value}, '-')"


def _oracle() -> str:
    def leaf(count: str) -> str:
        fields = ["doc_id::VARCHAR", "source", "lang", count, "text"]
        return f"sha256({' || '.join(_written(f) for f in fields)})"

    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, {leaf("n_chars::VARCHAR")} AS leaf,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0
              THEN {leaf("(n_chars + 1)::VARCHAR")} ELSE {leaf("n_chars::VARCHAR")} END AS claimed,
         dense_rank() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS grp
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY grp) AS total
  FROM leaves
), below AS (
  SELECT grp, 0 AS level, place, leaf AS h, total FROM placed
  UNION ALL
  SELECT grp, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (any_value(total) + 1) // 2
  FROM below WHERE total > 1 GROUP BY grp, level, place // 2
), subroots AS (
  SELECT grp, h AS subroot, level AS height FROM below WHERE total = 1
), above AS (
  SELECT 0 AS level, grp AS place, subroot AS h, (SELECT count(*) FROM subroots) AS total FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (any_value(total) + 1) // 2
  FROM above WHERE total > 1 GROUP BY level, place // 2
), steps AS (
  SELECT p.grp, p.place, l.level, (p.place >> l.level) & 1 AS odd, s.h AS sibling
  FROM placed p JOIN (SELECT DISTINCT grp, level FROM below WHERE total > 1) l ON l.grp = p.grp
  LEFT JOIN below s ON s.grp = p.grp AND s.level = l.level AND s.place = xor(p.place >> l.level, 1)
  UNION ALL
  SELECT p.grp, p.place, r.height + l.level, (p.grp >> l.level) & 1, s.h
  FROM placed p JOIN subroots r ON r.grp = p.grp CROSS JOIN (SELECT DISTINCT level FROM above WHERE total > 1) l
  LEFT JOIN above s ON s.level = l.level AND s.place = xor(p.grp >> l.level, 1)
), paths AS (
  SELECT grp, place, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256,
         list(CASE WHEN sibling IS NULL THEN '-' WHEN odd = 1 THEN 'L' || sibling ELSE 'R' || sibling END ORDER BY level) AS path
  FROM steps GROUP BY grp, place
), folded AS (
  SELECT p.doc_id, p.leaf, r.subroot, (SELECT h FROM above WHERE total = 1) AS root,
         coalesce(t.proof_sha256, sha256('')) AS proof_sha256,
         list_reduce(list_concat([p.claimed], coalesce(t.path, [])), lambda h, s:
           CASE s[1] WHEN '-' THEN sha256(h) WHEN 'L' THEN sha256(s[2:] || h) ELSE sha256(h || s[2:]) END) AS folded_root
  FROM placed p JOIN subroots r ON r.grp = p.grp LEFT JOIN paths t ON t.grp = p.grp AND t.place = p.place
)
SELECT *, folded_root = root AS verified FROM folded
"""


ORACLE = _oracle()
