"""Places of rows in a sort order, over everything or in their group, without a task that takes either whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.shared import materialize


def global_index(df: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """``df`` with its position from 0 in a total order: ranges are sorted apart and numbered by the counts before them."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = ranged.groupBy("__range").count().select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__range").orderBy(*order)
    return ranged.join(F.broadcast(starts), "__range").withColumn(name, (F.col("__start") + F.row_number().over(inside) - 1).cast("long")).drop("__range", "__start")


#: Starts (one row for each group and range) that are broadcast; more are joined by a shuffle.
BROADCAST_STARTS = 200_000


def positions(df: DataFrame, group: list[str], order: list[str], name: str = "position") -> DataFrame:
    """``df`` with the place of each row, from 0, among those of its group (columns without nulls) in ``order``.

    Ranges of (group, order) are sorted apart and written; a row's place is its
    number in its range plus the group's rows in the ranges before.  Rows that tie
    in everything are told apart by their place in the input, so that many equal
    rows are dealt over ranges like others.  ``df`` is a scan or a written table.
    """
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    keys = [*group, *order, "__tie"]
    placed = materialize(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie").withColumn("__at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("__range", F.shiftright("__at", 33))
    seen = placed.groupBy(*group, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = seen.select(*group, "__range", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    if seen.count() <= BROADCAST_STARTS:
        starts = F.broadcast(starts)
    return placed.join(starts, [*group, "__range"]).withColumn(name, F.col("__at") + F.col("__shift")).drop("__at", "__range", "__shift")
