"""Preference formatting of chosen and rejected conversations.

Both conversations of a pair are aligned turn by turn.  The turns before the first
difference are the longest common prefix; they are rendered once, as the prompt.
What follows on either side is that side's completion, in which only the content
of assistant turns is trained on.

The output has a row per rendered turn with its place in characters, so a
conversation of any length stays spread over tasks: the alignment is keyed by pair
and position, and running totals are taken in buckets.  Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.rows import table
from threadlake.operators.ranking import bucketed_index, global_index, running_total
from threadlake.session import materialize

# Fixed values of the chat template.
OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"

#: Turn numbers of a bucket when turns are put in order.
TURN_BUCKET = 256


def preference_segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Segments of prompts and completions of ``(pair_id, turn, role, text)`` tables.

    Returns ``pair_id, part, place, role, rendered, start, loss_start, loss_chars``:
    ``part`` is ``prompt``, ``chosen`` or ``rejected``; ``place`` and ``start`` count turns and
    characters from the part's beginning; ``loss_start`` and ``loss_chars`` are the
    trained characters of the part, null where a turn has none.  Turns go in the
    order of ``turn``, whose values need not be dense.  Null roles and texts count as
    empty.  Rows without pair or turn take no part; of rows that repeat pair and
    turn on one side the smallest role and text count.  A pair that is missing on one
    side has no prompt, equal conversations have no completions, empty tables
    give no rows; other columns are not read.
    """

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(
            F.col("pair_id").cast("bigint").alias("pair_id"),
            F.lit(name).alias("side"),
            F.col("turn").cast("bigint").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )

    turns = (
        side(chosen, "chosen")
        .unionByName(side(rejected, "rejected"))
        .filter("pair_id IS NOT NULL AND turn IS NOT NULL")
        .groupBy("pair_id", "side", "turn")
        .agg(F.min(F.struct("role", "text")).alias("said"))
    )
    bucket = F.floor(F.col("turn") / TURN_BUCKET).cast("bigint")
    placed = bucketed_index(turns, ["pair_id", "side"], bucket, ["turn"], "place", settle=True)
    on = lambda name: F.max(F.when(F.col("side") == name, F.col("said"))).alias(name)
    lined = materialize(
        placed.groupBy("pair_id", "place").agg(on("chosen"), on("rejected")), "aligned-turns"
    )
    apart = ~F.col("chosen").eqNullSafe(F.col("rejected"))
    split = lined.groupBy("pair_id").agg(F.min(F.when(apart, F.col("place"))).alias("split"))
    common = F.col("split").isNull() | (F.col("place") < F.col("split"))

    def piece(part: str, condition, place, said: str):
        return F.when(
            condition & F.col(said).isNotNull(),
            F.struct(F.lit(part).alias("part"), place.alias("place"), F.col(said).alias("said")),
        )

    later = F.col("place") - F.col("split")
    pieces = F.array_compact(
        F.array(
            piece("prompt", common, F.col("place"), "chosen"),
            piece("chosen", ~common, later, "chosen"),
            piece("rejected", ~common, later, "rejected"),
        )
    )
    segments = (
        lined.join(split, "pair_id")
        .select("pair_id", F.explode(pieces).alias("piece"))
        .select("pair_id", "piece.part", "piece.place", "piece.said.role", "piece.said.text")
    )
    head = F.concat(F.lit(OPEN), F.col("role"), F.lit(BREAK))
    rendered = segments.select(
        "pair_id",
        "part",
        "place",
        "role",
        F.concat(head, F.col("text"), F.lit(CLOSE)).alias("rendered"),
        F.length(head).cast("bigint").alias("head"),
    )
    ends = running_total(rendered, ["pair_id", "part"], "place", F.length("rendered"), "end")
    start = F.col("end") - F.length("rendered")
    trained = (F.col("part") != "prompt") & (F.col("role") == TRAINED_ROLE)
    return ends.select(
        "pair_id",
        "part",
        "place",
        "role",
        "rendered",
        start.alias("start"),
        F.when(trained, start + F.col("head")).alias("loss_start"),
        F.when(trained, F.length("rendered") - F.col("head")).alias("loss_chars"),
    )


def swapped_answers(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected conversations for a table that has no preferences.

    The chosen side is a conversation as it is; the rejected one has the last assistant
    turn of the next conversation that has one, by ``conv_id``, in the place of its own; after
    the last comes the first.  A conversation without an assistant turn, or the only one with
    such a turn, is equal on both sides, thus all prompt.
    """
    turns = conversations.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("pair_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
    )
    last = materialize(
        turns.filter(F.col("role") == TRAINED_ROLE)
        .groupBy("pair_id")
        # The last turn, and of rows repeating it the largest text.
        .agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last")),
        "last-answers",
    )
    ring = global_index(last, ["pair_id"], "at")
    before = F.when(F.col("at") == 0, F.lit(last.count())).otherwise(F.col("at")) - 1
    other = ring.select(before.alias("at"), F.col("last.text").alias("other"))
    pairs = ring.select("pair_id", "at", F.col("last.turn").alias("last_turn")).join(other, "at").drop("at")
    joined = turns.join(pairs, "pair_id", "left")
    chosen = joined.select("pair_id", "turn", "role", "text")
    swap = (F.col("turn") == F.col("last_turn")) & (F.col("role") == TRAINED_ROLE)
    rejected = joined.select(
        "pair_id", "turn", "role", F.when(swap, F.col("other")).otherwise(F.col("text")).alias("text")
    )
    return chosen, rejected


def preference_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_segments(*swapped_answers(table(spark, sf_dir, "conversations")))


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), l AS (
  SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS answer FROM t WHERE role = 'assistant' GROUP BY conv_id
), p AS (
  SELECT conv_id, last_turn,
         coalesce(lead(answer) OVER (ORDER BY conv_id), first_value(answer) OVER (ORDER BY conv_id)) AS other FROM l
), c AS (
  SELECT conv_id AS pair_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, coalesce(role, '') AS role,
         coalesce(text, '') AS chosen,
         coalesce(CASE WHEN turn = last_turn AND role = 'assistant' THEN other ELSE text END, '') AS rejected
  FROM t LEFT JOIN p USING (conv_id)
), s AS (
  SELECT *, min(CASE WHEN chosen <> rejected THEN place END) OVER (PARTITION BY pair_id) AS split FROM c
), e AS (
  SELECT pair_id, 'prompt' AS part, place, role, chosen AS text FROM s WHERE split IS NULL OR place < split
  UNION ALL SELECT pair_id, 'chosen', place - split, role, chosen FROM s WHERE place >= split
  UNION ALL SELECT pair_id, 'rejected', place - split, role, rejected FROM s WHERE place >= split
), r AS (
  SELECT pair_id, part, place, role,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered, length(role) + 13 AS head FROM e
), f AS (
  SELECT *, CAST(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY place) - length(rendered) AS BIGINT) AS start
  FROM r
)
SELECT pair_id, part, place, role, rendered, start,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + head END AS loss_start,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(rendered) - head END AS loss_chars
FROM f
"""
