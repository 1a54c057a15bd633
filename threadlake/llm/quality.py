"""Quality classifier: a sparse rule ensemble compiled into column expressions.

The statistics of a text, the rules over them and the score are built-in column
expressions, so scoring is one projection over the scan: no shuffle, no Python.
Only fitting leaves Spark: the statistics of at most ``SAMPLE_ROWS`` labelled
documents, a bound that does not grow with the data, go to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.rows import table
from threadlake.llm.rule_ensemble import Ensemble, fit

#: Labelled documents to learn from, the first in the order of a hash of the id.
SAMPLE_ROWS = 20_000

#: Folds by crc32 of the id as text; fold 0 is never learned from.
FOLDS = 5

#: A document is accepted from this score.
ACCEPT = 0.3

STATISTICS = (
    "log_chars",
    "log_words",
    "word_chars",
    "upper_share",
    "symbol_share",
    "shout_share",
    "bar_share",
    "digit_share",
    "stop_share",
    "wide_share",
    "line_words",
    "repeat_share",
    "distinct_share",
)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the struct ``statistics`` of doubles; a null text counts as empty.

    The input's columns are kept in one struct ``row``.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    clean = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.struct(*columns).alias("row"), clean.alias("t"))
    split = base.select(
        "row", "t", F.filter(F.split("t", "[ \t\r\n]+"), lambda w: w != "").alias("words")
    )
    count = F.size("words").cast("double")
    chars = F.length("t").cast("double")

    def per(part: Column, whole: Column) -> Column:
        return F.coalesce(part.cast("double") / F.nullif(whole, F.lit(0.0)), F.lit(0.0))

    def share(characters: str) -> Column:
        """Characters of a class, as a share of the text."""
        return per(F.length(F.regexp_replace("t", f"[^{characters}]+", "")), chars)

    next_to = F.zip_with(
        F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))),
        F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))),
        lambda a, b: a == b,
    )
    values = {
        "log_chars": F.log1p(chars),
        "log_words": F.log1p(count),
        "word_chars": per(chars - count + 1, count),
        "upper_share": share("A-Z"),
        "symbol_share": share("%*#$&@^~<>{}=_+"),
        "shout_share": share("!?"),
        "bar_share": share("|\\\\/"),
        "digit_share": share("0-9"),
        "stop_share": share(".,;:"),
        "wide_share": per(F.octet_length("t") - chars, chars),
        "line_words": per(count, F.size(F.split("t", "\n")).cast("double")),
        "repeat_share": per(F.size(F.filter(next_to, lambda same: same)), count),
        "distinct_share": per(F.size(F.array_distinct("words")), count),
    }
    return split.select("row", F.struct(*[values[s].alias(s) for s in STATISTICS]).alias("statistics"))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    doc_id: str = "doc_id",
    text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> Ensemble:
    """Fit on labelled documents outside fold 0.

    Labels other than 0 and 1 and ids labelled both ways are left out.
    """
    spark = docs.sparkSession
    sample = (
        labels.filter((F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0) & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(label).alias("y"), F.max(label).alias("most"))
        .filter("y = most")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
        .select(F.col("doc_id").alias("key"), F.col("y").cast("int").alias("y"))
        .collect()
    )
    if not sample:
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    # At most sample_rows ids, so every task can hold them.
    chosen = F.broadcast(spark.createDataFrame(sample, "key bigint, y int"))
    few = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text")).join(chosen, "key")
    # One row for each id, however often it repeats; of several texts the smallest counts.
    few = few.groupBy("key", "y").agg(F.min("text").alias("text"))
    rows = statistics(few).select("row.key", "row.y", "statistics.*").toPandas()
    rows = rows.sort_values(list(rows.columns), ignore_index=True)
    return fit(rows[list(STATISTICS)].to_numpy(float), rows["y"].to_numpy(float))


def score_column(model: Ensemble) -> Column:
    """The model over a column ``statistics``."""

    def holds(rule) -> Column:
        out = F.lit(True)
        for feature, above, threshold in rule.conditions:
            value = F.col("statistics")[STATISTICS[feature]]
            out = out & (value > threshold if above else value <= threshold)
        return out

    z = F.lit(model.intercept)
    for rule, weight in model.rules:
        z = z + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def score(docs: DataFrame, model: Ensemble, text: str = "text") -> DataFrame:
    """``row`` (the input's columns), ``score`` from 0 to 1 and ``predicted``.

    Every row is scored by itself, so repeated rows get equal scores; null and
    empty texts get the score of a text without words; no rows, no scores.
    """
    scored = statistics(docs, text).select("row", score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    fold = F.crc32(F.col("row.doc_id").cast("string")) % FOLDS
    return score(docs, model).select(
        "row.doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).filter("predicted = 1").select("row.*")
