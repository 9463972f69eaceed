"""Places in a total order without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.components import durable


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place from 1 in the order. Rows are dealt by range, and a part's places
    start after the numbers of rows of the parts before, of which there is one a partition."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = durable(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)), "ranks")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    starts = sizes.select("_part", before.alias("_before"))
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_before") + F.col("_row") + 1).cast("int")).drop("_part", "_row", "_before")
