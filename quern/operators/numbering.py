"""Numbers and ranks within groups of any size, in two levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut


def numbered(df: DataFrame, by: list[str], order: list, out: str = "rn", total: str | None = None) -> DataFrame:
    """df with the number from 1 on of each row in its group, in a total order, and with the group's size if total names it.

    The rows are parted into ranges of (by, order), so a group as large as a third of the table
    spreads over many tasks, each range is numbered by itself, and only the counts by group and
    range, a handful of rows, meet in a window. The ranges are written once, since a second run
    could part them otherwise. Null is a group of its own.
    """
    keys = [F.col(c) for c in by]
    parted = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    parted = cut(parted, "numbered")
    counts = parted.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        counts = counts.withColumn(total, F.sum("_n").over(Window.partitionBy(*by)))
    within = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    x = parted.withColumn("_at", within).alias("x")
    small = F.broadcast(counts.drop("_n")).alias("c")  # groups times ranges, at most one row for each group in each task
    same = F.col("x._part") == F.col("c._part")
    for c in by:
        same &= F.col(f"x.{c}").eqNullSafe(F.col(f"c.{c}"))
    cols = [F.col(f"x.{c}") for c in df.columns]
    return x.join(small, same).select(*cols, (F.col("_at") + F.col("_before")).cast("long").alias(out), *([total] if total else []))
