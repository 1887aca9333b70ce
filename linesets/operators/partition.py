"""Partition of lines by their length after the codec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesets.functions.codec import ByteClass, recode


def file_name(template: str, length: Column, mark: str = "#") -> Column:
    """template with _NN in place of the mark, or appended; two digits at least."""
    head, found, tail = template.partition(mark)
    digits = F.when(length < 100, F.lpad(length.cast("string"), 2, "0")).otherwise(length.cast("string"))
    return F.concat(F.lit(head if found else template), F.lit("_"), digits, F.lit(tail if found else ""))


def split_by_length(
    df: DataFrame, template: str, key: str = "line", decode: bool = False, byte_class: ByteClass | None = None, mark: str = "#"
) -> DataFrame:
    """Rows with the re-encoded line, its length and the file it belongs to."""
    coded = df.withColumn(key, recode(F.col(key), decode, byte_class))
    coded = coded.withColumn("len", F.octet_length(F.col(key)).cast("bigint"))
    return coded.withColumn("file", file_name(template, F.col("len"), mark))


def partition_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
