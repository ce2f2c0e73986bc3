"""Numbering that survives one group holding a large share of all rows.

Joins need no help here: the session lets Spark split a skewed side of a join at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

def range_slices(df: DataFrame, order: list[Column], slices: int | None = None) -> DataFrame:
    """Range-partition by `order` and tag rows with their slice number.

    Slices follow the order, so a large group spans several of them. Sampling picks the
    boundaries; the checkpoint pins them so that totals and rows agree.
    """
    n = slices or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = df.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id())
    return materialise(ranged)


def with_positions(
    df: DataFrame, group: list[str], order: list[str], name: str = "position",
    slices: int | None = None, narrow: bool = False,
) -> DataFrame:
    """1-based position of each row within its group, no group confined to one task.

    `order` columns (ascending, not NULL) must be unique within a group. Local numbers are
    taken per (group, slice); the offset of a slice is the sum of the group's earlier slices,
    of which there are at most as many as slices. Only the key columns are sliced and
    checkpointed, and wide rows get their number by one join on the unique key; `narrow` rows
    are carried along instead.
    """
    cols = df.columns if narrow else group + order
    sliced = range_slices(df.select(*cols), [F.col(c) for c in group + order], slices)
    part = group + ["_slice"]
    sizes = sliced.groupBy(*part).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    local = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    numbered = sliced.withColumn("_local", local)
    positions = numbered.join(offsets.drop("_size"), part).select(
        *cols, (F.col("_offset") + F.col("_local")).cast("bigint").alias(name)
    )
    return positions if set(df.columns) == set(cols) else df.join(positions, group + order)
