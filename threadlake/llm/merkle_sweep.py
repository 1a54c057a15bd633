"""Hash trees over ordered rows by time-forward processing.

Nodes are labelled ``(level, place)`` in the order in which they can be computed.  A
node that is done sends its digest to its parent through a priority queue ordered by
label, so a node finds the digests of its children at the front of the queue when its
turn comes.  A second sweep in reverse order sends every node the rest of its proof, the
siblings from its parent up to the root, and so brings whole proofs to the leaves.

The queue is external: the tree is cut into blocks of ``2 ** LEVELS`` neighbouring nodes.
Messages within a block go through a heap in one task; a message to another block, the
digest of the block's top node or the proof that hangs above it, is a row of a written
table, and Spark's shuffle brings these rows to their blocks in order of labels.  So a
task holds a block, never a tree, and a billion leaves take three rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.session import materialize

#: A block holds so many levels, thus 2 ** LEVELS nodes of its lowest one.
LEVELS = 12

#: How a proof marks on which side of the path a sibling stands; ALONE has no sibling.
LEFT, RIGHT, ALONE = "L", "R", "-"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sweep_up(digests: list[str], levels: int) -> dict[tuple[int, int], str]:
    """The digests of all nodes over neighbouring ``digests``, ``levels`` levels up."""
    done: dict[tuple[int, int], str] = {}
    queue = [(0, place, value) for place, value in enumerate(digests)]
    while queue:
        level, place, value = heappop(queue)
        done[level, place] = value
        if level == levels:
            continue
        if not place % 2 and queue and queue[0][:2] == (level, place + 1):
            _, _, other = heappop(queue)
            done[level, place + 1] = other
            value = digest(value, other)
        else:
            value = digest(value)
        heappush(queue, (level + 1, place // 2, value))
    return done


def sweep_down(nodes: dict[tuple[int, int], str], levels: int, above: str) -> Iterator[tuple[int, str]]:
    """``(place, proof)`` of each lowest node; ``above`` is the proof of the top node."""
    queue = [(-levels, 0, above)]
    while queue:
        level, place, proof = heappop(queue)
        if not level:
            yield place, proof
            continue
        left, right = (-level - 1, 2 * place), (-level - 1, 2 * place + 1)
        if right in nodes:
            heappush(queue, (level + 1, left[1], f"{RIGHT}{nodes[right]} {proof}"))
            heappush(queue, (level + 1, right[1], f"{LEFT}{nodes[left]} {proof}"))
        else:
            heappush(queue, (level + 1, left[1], f"{ALONE} {proof}"))


def fold(leaf: str, proof: str) -> str:
    """The root that a leaf and its proof lead to."""
    for step in proof.split():
        if step[0] == LEFT:
            leaf = digest(step[1:], leaf)
        elif step[0] == RIGHT:
            leaf = digest(leaf, step[1:])
        else:
            leaf = digest(leaf)
    return leaf


def siblings_digest(proof: str) -> str:
    """The digest of a proof's siblings, from the leaf to the root."""
    return digest(*(step[1:] for step in proof.split()))


def _block_levels(total: int, levels: int) -> int:
    """How many levels a block rises: all, or as far as a single node is left."""
    return levels if total > 1 << levels else (total - 1).bit_length()


class Forest:
    """The hash trees of all groups of ``nodes(grp, place, digest)``.

    Places are dense from 0 in each group; ``grp`` is a number, digests are binary.  ``tops`` has
    a row ``grp, digest`` for each group, what remains of its leaves.  Other columns of
    ``nodes`` go to ``finish`` of ``proofs``.  No nodes give no tops and no proofs.
    """

    def __init__(self, nodes: DataFrame, name: str, levels: int = LEVELS):
        self.levels = levels
        self.name = name
        counts = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("total"))
        current = materialize(nodes.join(counts, "grp"), f"{name}-0")
        self.rounds = [current]
        while not current.filter("total > 1").isEmpty():
            current = materialize(self._up(current), f"{name}-{len(self.rounds)}")
            self.rounds.append(current)
        self.tops = current.select("grp", "digest")

    def _blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.shiftright("place", self.levels))

    def _up(self, nodes: DataFrame) -> DataFrame:
        """The top node of every block, as the nodes of the next round."""
        levels = self.levels

        def up(block: pa.Table) -> pa.Table:
            block = block.sort_by("place")
            total = block["total"][0].as_py()
            rise = _block_levels(total, levels)
            nodes = sweep_up([d.hex() for d in block["digest"].to_pylist()], rise)
            return pa.table(
                {
                    "grp": block["grp"][:1],
                    "place": block["block"][:1],
                    "total": pa.array([-(-total // (1 << levels))], pa.int64()),
                    "digest": pa.array([bytes.fromhex(nodes[rise, 0])], pa.binary()),
                }
            )

        narrow = self._blocks(nodes.select("grp", "place", "total", "digest"))
        return narrow.groupBy("grp", "block").applyInArrow(up, "grp bigint, place bigint, total bigint, digest binary")

    def proofs(self, above: DataFrame, finish=None, columns: str = "") -> DataFrame:
        """The proofs of all leaves: ``grp, place, proof``, or what ``finish`` makes of them.

        ``above(grp, proof)`` has the proof that hangs over each group's tree.
        ``finish(leaves, proofs)`` takes neighbouring leaves as a table in the order of places
        and a proof for each; it returns a table of the ``columns``.
        """
        message = materialize(above.select("grp", F.lit(0).cast("bigint").alias("block"), "proof"), f"{self.name}-above")
        for number in reversed(range(1, len(self.rounds) - 1)):
            message = materialize(
                self._down(self.rounds[number], message).select("grp", F.col("place").alias("block"), "proof"),
                f"{self.name}-proofs-{number}",
            )
        return self._down(self.rounds[0], message, finish, columns)

    def _down(self, nodes: DataFrame, message: DataFrame, finish=None, columns: str = "") -> DataFrame:
        levels = self.levels

        def down(block: pa.Table, above: pa.Table) -> pa.Table:
            block = block.sort_by("place")
            rise = _block_levels(block["total"][0].as_py(), levels)
            nodes = sweep_up([d.hex() for d in block["digest"].to_pylist()], rise)
            proofs = [""] * len(block)
            for place, proof in sweep_down(nodes, rise, above["proof"][0].as_py()):
                proofs[place] = proof
            if finish:
                return finish(block, proofs)
            return pa.table({"grp": block["grp"], "place": block["place"], "proof": pa.array(proofs, pa.string())})

        left = self._blocks(nodes).groupBy("grp", "block")
        return left.cogroup(message.groupBy("grp", "block")).applyInArrow(down, columns or "grp bigint, place bigint, proof string")
