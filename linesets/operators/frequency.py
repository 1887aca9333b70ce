"""Frequency tables, running statistics and length histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linesets.functions.keys import byte_length
from linesets.operators.order import rank_within


def frequency(df: DataFrame, key: str = "line") -> DataFrame:
    """(line, cnt, len) of each distinct line; no order."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("cnt")).withColumn("len", byte_length(F.col(key)))


def frequency_order(freq: DataFrame, key: str = "line") -> DataFrame:
    return freq.orderBy(F.col("cnt").desc(), F.col(key).asc())


def running(freq: DataFrame, key: str = "line", like: DataFrame | None = None) -> DataFrame:
    """Adds pct and cumul, in the order count descending, bytes ascending.

    The running sum has two levels: a total for each count (few distinct
    counts), summed up over counts, and a rank inside each count. Lines with one
    count add that count each, so no window holds more than the distinct
    counts or one slice of the lines. like: a table whose lines lie about alike, where it is cheaper to read.
    """
    levels = freq.groupBy("cnt").agg((F.count(F.lit(1)) * F.col("cnt")).alias("_level"))
    over = Window.orderBy(F.col("cnt").desc())
    levels = levels.select(
        "cnt",
        F.coalesce(F.sum("_level").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_level").over(Window.partitionBy()).alias("_total"),
    )
    joined = rank_within(freq, "cnt", [F.col(key)], like=like).join(levels, "cnt")
    total = F.col("_total").cast("double")
    upto = (F.col("_before") + F.col("cnt") * F.col("_rank")).cast("double")
    return joined.select(
        *freq.columns,
        (F.col("cnt").cast("double") * F.lit(100.0) / total).alias("pct"),
        (upto * F.lit(100.0) / total).alias("cumul"),
    )


def length_histogram(df: DataFrame, key: str = "line", max_length: int | None = 1_000_000) -> DataFrame:
    """(len, cnt, pct, cumul) over distinct lines, count descending then length.

    Empty if a line has max_length bytes or more; None is no limit. The window is over one row for
    each length.
    """
    lengths = df.select(key).distinct().groupBy(byte_length(F.col(key)).alias("len")).agg(F.count(F.lit(1)).alias("cnt"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cnt").desc(), F.col("len").asc()).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("cnt").over(everything).cast("double")
    return lengths.select(
        "len", "cnt",
        (F.col("cnt").cast("double") * F.lit(100.0) / total).alias("pct"),
        (F.sum("cnt").over(order).cast("double") * F.lit(100.0) / total).alias("cumul"),
        F.max("len").over(everything).alias("_longest"),
    ).filter(F.lit(True) if max_length is None else F.col("_longest") < max_length).drop("_longest")


def length_bounds(df: DataFrame, key: str = "line") -> DataFrame:
    """(min_len, max_len) of the raw bytes."""
    n = byte_length(F.col(key))
    return df.agg(F.min(n).alias("min_len"), F.max(n).alias("max_len"))


def match_counts(df: DataFrame, removes: DataFrame, key: str = "line") -> DataFrame:
    """(file_idx, matched): distinct lines first met in list k."""
    from linesets.operators.setops import attribution

    return attribution(df.select(key).distinct(), removes, key).withColumnRenamed("removed", "matched")
