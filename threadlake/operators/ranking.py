"""Positions within ordered groups that never put a whole group into one task.

A plain ``row_number() over (partition by group)`` sorts each group in a single
task, which fails when one group holds a large share of the data.  Here a group
is cut into ordered buckets: the number of rows in the earlier buckets comes
from a small aggregate, and only the rows of one bucket are sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.session import materialize

#: Rows per bucket when the order is a dense number.
BUCKET_ROWS = 1 << 16

_BUCKET, _BEFORE, _LOCAL = "_bucket", "_before", "_local"


def _running_before(counts: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the earlier buckets of the group."""
    earlier = (
        Window.partitionBy(*group)
        .orderBy(_BUCKET)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return counts.withColumn(name, F.coalesce(F.sum(value).over(earlier), F.lit(0)))


def bucketed_index(
    df: DataFrame,
    group: Sequence[str],
    bucket: Column,
    order: Sequence[Column | str],
    name: str,
    start: int = 0,
    settle: bool = False,
) -> DataFrame:
    """Dense position of each row in its group.

    ``bucket`` must not decrease along ``order`` and neither it nor the group
    columns may be null.  ``settle`` writes the rows after the local ranking, so
    that an expensive input is not computed a second time for the bucket counts.
    """
    keys = [*group, _BUCKET]
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    keyed = df.withColumn(_BUCKET, bucket)
    if settle:
        keyed = materialize(keyed.withColumn(_LOCAL, local.cast("bigint")), name)
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    before = _running_before(counts, group, "_rows", _BEFORE).drop("_rows")
    if not settle:
        keyed = keyed.withColumn(_LOCAL, local.cast("bigint"))
    return (
        keyed.join(before, keys)
        .withColumn(name, F.col(_BEFORE) + F.col(_LOCAL) + F.lit(start - 1))
        .select(*[c for c in df.columns if c != name], name)
    )


def dense_index(
    df: DataFrame, group: Sequence[str], position: str, name: str, start: int = 0
) -> DataFrame:
    """Position within the group along a unique, dense numeric column."""
    bucket = F.floor(F.col(position) / BUCKET_ROWS).cast("bigint")
    return bucketed_index(df, group, bucket, [position], name, start)


def running_total(
    df: DataFrame,
    group: Sequence[str],
    position: str,
    value: Column,
    name: str,
) -> DataFrame:
    """Running sum of ``value`` along a dense numeric column, own row included."""
    bucket = F.floor(F.col(position) / BUCKET_ROWS).cast("bigint")
    keyed = df.withColumn(_BUCKET, bucket).withColumn("_value", value.cast("bigint"))
    keys = [*group, _BUCKET]
    sums = keyed.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    before = _running_before(sums, group, "_sum", _BEFORE).drop("_sum")
    within = (
        Window.partitionBy(*keys)
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        keyed.withColumn(_LOCAL, F.sum("_value").over(within))
        .join(before, keys)
        .withColumn(name, F.col(_BEFORE) + F.col(_LOCAL))
        .select(*[c for c in df.columns if c != name], name)
    )


def with_previous(
    df: DataFrame, group: Sequence[str], position: str, columns: Sequence[str], prefix: str = "prev_"
) -> DataFrame:
    """Add the named columns of the preceding row (dense positions from 0).

    The last row of every bucket is also sent to the next bucket, so that no
    bucket needs another one to look back.
    """
    number = F.floor(F.col(position) / BUCKET_ROWS).cast("bigint")
    is_last = F.pmod(F.col(position), F.lit(BUCKET_ROWS)) == BUCKET_ROWS - 1
    targets = F.when(is_last, F.array(number, number + 1)).otherwise(F.array(number))
    spread = df.select("*", F.explode(targets).alias(_BUCKET))
    window = Window.partitionBy(*group, _BUCKET).orderBy(position)
    for column in columns:
        spread = spread.withColumn(prefix + column, F.lag(column).over(window))
    return spread.filter(number == F.col(_BUCKET)).drop(_BUCKET)


def global_index(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Dense position from 0 over the whole table.

    The sorted rows are written once; each part knows its own row numbers, and
    the part offsets (one row per part) come from a second small aggregate.
    """
    ordered = materialize(
        df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), f"sorted-{name}"
    )
    part = F.shiftright("_id", 33)
    parts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(
        "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias(_BEFORE)
    )
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ordered.withColumn("_part", part)
        # One row per partition of the sort.
        .join(F.broadcast(before), "_part")
        .withColumn(name, F.col(_BEFORE) + within)
        .drop("_part", "_id", _BEFORE)
    )
