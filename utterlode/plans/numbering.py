"""Numbers in a global order without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import saved


def numbered(rows: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """``rows`` with their place in ``order``, which should be total, as ``name``.

    Rows are range-partitioned and sorted; a row's number is its place in the partition plus the sizes of those before it.
    Only these sizes, one a partition, meet in a window.
    """
    width = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
    placed = saved(sorted_.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)  # fixed layout of that function
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    return placed.join(F.broadcast(ahead), part == F.col("_part")).withColumn(name, F.col("_ahead") + within + start).drop("_at", "_part", "_ahead")
