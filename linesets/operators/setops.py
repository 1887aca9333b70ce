"""Set algebra over lines. `order` names the columns that give a row its place."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linesets.functions.keys import line_hash, prefix_key


def _ranked(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    # rn = 1 becomes a WindowGroupLimit, which prunes before the shuffle
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def dedupe_first(df: DataFrame, order: Sequence[str], key: str = "line") -> DataFrame:
    """First occurrence of each key."""
    return _ranked(df, [key], order).filter("_rn = 1").drop("_rn")


def duplicates(df: DataFrame, order: Sequence[str], key: str = "line") -> DataFrame:
    """Every occurrence but the first.

    The first places come from a map-side combined minimum, so a key with most
    of the rows never meets in one task; the join splits skewed keys.
    """
    place = F.struct(*[F.col(c) for c in order])
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(place).alias("_first"))
    joined = df.join(first, df[key] == first["_key"])
    return joined.filter(place > F.col("_first")).drop("_key", "_first")


def union_removes(*removes: DataFrame, key: str = "line") -> DataFrame:
    """All remove lists as (file_idx, line), file_idx from 1 in their order."""
    tagged = [r.select(F.lit(i).alias("file_idx"), F.col(key).alias("line")) for i, r in enumerate(removes, 1)]
    return reduce(DataFrame.unionByName, tagged)


def _keys(removes: DataFrame, key: str, how: str | None) -> DataFrame:
    keys = removes.select(F.col("line").alias(key)).filter(F.col(key).isNotNull()).distinct()
    return keys.hint(how) if how else keys


def remove(df: DataFrame, removes: DataFrame, key: str = "line", how: str | None = None) -> DataFrame:
    """Rows whose key is in no remove list. how: 'merge' for sorted inputs."""
    return df.join(_keys(removes, key, how), key, "left_anti")


def common(df: DataFrame, removes: DataFrame, key: str = "line", how: str | None = None) -> DataFrame:
    """Rows whose key is in at least one remove list."""
    return df.join(_keys(removes, key, how), key, "left_semi")


def attribution(df: DataFrame, removes: DataFrame, key: str = "line") -> DataFrame:
    """(file_idx, removed): rows taken by list k and by no list before it."""
    first = removes.groupBy(F.col("line").alias(key)).agg(F.min("file_idx").alias("file_idx"))
    return df.select(key).join(first, key).groupBy("file_idx").agg(F.count(F.lit(1)).alias("removed"))


def dedupe_prefix(df: DataFrame, n: int, order: Sequence[str], key: str = "line") -> DataFrame:
    """One row for each n-byte prefix: the smallest whole line, then the first."""
    keyed = df.withColumn("_prefix", prefix_key(F.col(key), n))
    return _ranked(keyed, ["_prefix"], [key, *order]).filter("_rn = 1").drop("_rn", "_prefix")


def _by_prefix(df: DataFrame, removes: DataFrame, n: int, key: str, how: str) -> DataFrame:
    right = removes.select(prefix_key(F.col("line"), n).alias("_prefix")).distinct()
    return df.withColumn("_prefix", prefix_key(F.col(key), n)).join(right, "_prefix", how).drop("_prefix")


def remove_prefix(df: DataFrame, removes: DataFrame, n: int, key: str = "line") -> DataFrame:
    return _by_prefix(df, removes, n, key, "left_anti")


def common_prefix(df: DataFrame, removes: DataFrame, n: int, key: str = "line") -> DataFrame:
    return _by_prefix(df, removes, n, key, "left_semi")


def removal_counts(df: DataFrame, removes: DataFrame | None, key: str = "line", dedupe: bool = True, keep_common: bool = False) -> DataFrame:
    """(metric, value) of a run in one pass over the input: total, uniques, duplicates, list_k, matched and written.

    Rows are counted by key, and keys by the first list that holds them, so what is summed up at
    last is one row a list.
    """
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if removes is None:
        tagged = per_key.withColumn("file_idx", F.lit(None).cast("int"))
    else:
        first = removes.groupBy(F.col("line").alias(key)).agg(F.min("file_idx").alias("file_idx"))
        tagged = per_key.join(first, key, "left")
    lists = tagged.groupBy("file_idx").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys")).withColumn("kept", F.col("keys") if dedupe else F.col("n"))
    hit = F.col("file_idx").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    matched = F.sum(F.when(hit, F.col("kept")))
    written = matched if keep_common else F.sum(F.when(~hit, F.col("kept")))
    flat = lists.agg(
        zero(F.sum("n")).alias("total"), zero(F.sum("keys")).alias("uniques"), zero(F.sum("n") - F.sum("keys")).alias("duplicates"),
        zero(matched).alias("matched"), zero(written).alias("written"), F.collect_list(F.when(hit, F.struct("file_idx", "kept"))).alias("lists"),
    )
    rows = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("total", "uniques", "duplicates", "matched", "written")]
    by_list = F.transform("lists", lambda x: F.struct(F.concat(F.lit("list_"), x["file_idx"].cast("string")).alias("metric"), x["kept"].cast("bigint").alias("value")))
    return flat.select(F.explode(F.concat(F.array(*rows), by_list)).alias("m")).select("m.metric", "m.value")


def dedupe_hash(df: DataFrame, order: Sequence[str], key: str = "line") -> DataFrame:
    """First occurrence by 64-bit hash alone: smaller state, may merge lines."""
    hashed = df.withColumn("_hash", line_hash(F.col(key)))
    return _ranked(hashed, ["_hash"], order).filter("_rn = 1").drop("_rn", "_hash")


def dedupe_files(*files: DataFrame, order: Sequence[str], key: str = "line") -> DataFrame:
    """First occurrence over a concatenation; file_idx from 1 leads the order."""
    tagged = [f.select(F.lit(i).alias("file_idx"), *order, key) for i, f in enumerate(files, 1)]
    return dedupe_first(reduce(DataFrame.unionByName, tagged), ["file_idx", *order], key)


def counts(df: DataFrame, key: str = "line") -> DataFrame:
    """(total, uniques, duplicates), by two partial aggregations."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"),
        F.count(F.lit(1)).alias("uniques"),
        F.coalesce(F.sum("n") - F.count(F.lit(1)), F.lit(0)).cast("bigint").alias("duplicates"),
    )
