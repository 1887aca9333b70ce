"""Gapless places inside groups, however large a group is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linesets.llm._common import materialize


def with_slots(df: DataFrame, group: str, name: str) -> DataFrame:
    """df with a place from 0 inside each group (a column without nulls).

    A group's rows are numbered inside each of df's partitions, and those numbers
    are offset by the counts of the partitions before it, so a group with most of
    the rows is numbered by many tasks. The rows are written once with their partition, so a
    task that runs again can't number them anew.
    """
    rows = materialize(df.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "slots")
    sizes = rows.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(group, "_part").orderBy("_row")) - 1)
    placed = local.join(bases, [group, "_part"]).withColumn(name, F.col("_base") + F.col("_local"))
    return placed.drop("_part", "_row", "_local", "_base")
