"""Numbering, canonical orders and positional statistics without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.runtime import materialize


def global_row_number(df: DataFrame, order: list[Column], name: str = "rn", start: int = 0) -> DataFrame:
    """Number rows start, start+1, ... in a total order, without one task seeing all rows.

    Rows are range-partitioned and written once, so that the partition borders are
    settled; a running sum over the partitions' counts (as many rows as partitions)
    gives each its offset. Ties are numbered in an arbitrary but fixed order.
    """
    part = f"__part_{name}"
    placed = df.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    placed = materialize(placed, "numbered")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    local = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    # one row per partition of the range exchange: bounded by the number of partitions
    return (
        placed.withColumn("__local", local)
        .join(F.broadcast(offsets), part)
        .withColumn(name, (F.col("__off") + F.col("__local") - 1 + F.lit(start)).cast("long"))
        .drop(part, "__local", "__off")
    )
