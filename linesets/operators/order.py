"""Orders over lines, ordinals without one-task windows, and sortedness."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows whose keys give the borders of slices, and leading bytes of a line in a border: both bound what comes to the driver.
SAMPLE, BORDER_BYTES = 4096, 200
#: Up to so many borders a row is compared with each, else by halving.
FEW = 32


def by_bytes(order: Sequence[str] = (), key: str = "line") -> list[Column]:
    return [F.col(key).cast("binary"), *map(F.col, order)]


def by_place(order: Sequence[str]) -> list[Column]:
    return list(map(F.col, order))


def by_length(length: Column, order: Sequence[str]) -> list[Column]:
    return [length, *map(F.col, order)]


def sort_bytes(df: DataFrame, order: Sequence[str], key: str = "line") -> DataFrame:
    return df.orderBy(*by_bytes(order, key))


def restore_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*by_place(order))


def sort_by_length(df: DataFrame, length: Column, order: Sequence[str]) -> DataFrame:
    return df.withColumn("len", length).orderBy(*by_length(F.col("len"), order))


def _short(df: DataFrame, by: Sequence[Column]) -> list[Column]:
    """The order's columns with long values cut, which keeps the order of rows that still differ."""
    kinds = df.select(*[c.alias(f"k{i}") for i, c in enumerate(by)]).dtypes
    return [F.substring(c.cast("binary"), 1, BORDER_BYTES) if kind in ("string", "binary") else c for c, (_, kind) in zip(by, kinds, strict=True)]


def slices(df: DataFrame, by: Sequence[Column], n: int | None = None) -> Callable[[DataFrame], Column]:
    """Numbers of slices, as an expression for any table with the order's columns: as many ranges of the order as there are
    shuffle partitions, about alike in rows of df.

    Borders come from the rows of df with the smallest hashes and stand in the plan as values, so slices are a
    function of the row and a repeated task finds the same ones.
    """
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = _short(df, by)
    names = [f"k{i}" for i in range(len(by))]
    key = F.struct(*[c.alias(k) for c, k in zip(short, names, strict=True)])
    drawn = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    schema = drawn.schema["k"].dataType
    keys = [r["k"] for r in drawn.distinct().orderBy("k").collect()] if n > 1 else []
    borders = [keys[len(keys) * i // n] for i in range(1, n)] if len(keys) >= n else keys[1:]
    values = [[F.lit(bytes(v) if isinstance(v, bytearray) else v).cast(f.dataType).alias(f.name) for v, f in zip(b, schema.fields, strict=True)] for b in borders]

    def number(rows: DataFrame) -> Column:
        own = _short(rows, by)
        if len(borders) <= FEW:  # each compared
            one = len(by) == 1
            mine = own[0] if one else F.struct(*[c.alias(k) for c, k in zip(own, names, strict=True)])
            return sum((F.when(mine >= (v[0] if one else F.struct(*v)), 1).otherwise(0) for v in values), F.lit(0))
        # halving: as many steps as the number of borders has bits
        mine = F.struct(*[c.alias(k) for c, k in zip(own, names, strict=True)])
        steps, sorted_ = F.array(*[F.lit(1 << k) for k in reversed(range(len(borders).bit_length()))]), F.array(*[F.struct(*v) for v in values])
        passed = lambda at, step: (at + step <= len(borders)) & (F.get(sorted_, at + step - 1) <= mine)
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(passed(at, step), at + step).otherwise(at))

    return number


def with_ordinal(df: DataFrame, by: Sequence[Column], name: str = "ord", like: DataFrame | None = None) -> DataFrame:
    """Ordinal from 1 of each row in an order without ties.

    Rows are numbered inside slices of the order and slices are offset by their sizes, so
    no task sees all rows and a common beginning or length doesn't gather them either; the only
    window over all holds one row a slice. like: a table whose rows lie about like those of df, where it is cheaper to read.
    """
    sliced = df.withColumn("_slice", slices(df if like is None else like, by)(df))
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy("_slice").orderBy(*by))
    numbered = sliced.withColumn("_local", local).join(sizes, "_slice")
    return numbered.withColumn(name, (F.col("_base") + F.col("_local")).cast("bigint")).drop("_slice", "_base", "_local")


def rank_within(df: DataFrame, group: str, by: Sequence[Column], name: str = "_rank", like: DataFrame | None = None) -> DataFrame:
    """Rank from 1 in an order without ties inside each group, however large one is: by slices, as in with_ordinal."""
    sliced = df.withColumn("_slice", slices(df if like is None else like, by)(df))
    sizes = sliced.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(*by))
    ranked = sliced.withColumn("_local", local).join(sizes, [group, "_slice"])
    return ranked.withColumn(name, F.col("_base") + F.col("_local")).drop("_slice", "_base", "_local")


def sortedness_violations(df: DataFrame, group: Sequence[str], order: Sequence[str], key: str = "line") -> DataFrame:
    """Rows smaller than the row before them in their group, with that row."""
    over = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("prev", F.lag(key).over(over)).filter(F.col("prev") > F.col(key))


def _splits(batches: Iterator) -> Iterator:
    """Rows (file_idx, block, key) as the reader gives them -> first and last key of each run of a split, and its first row out of order."""
    import itertools

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ["file_idx", "block", "run", "first", "last", "prev", "line"]
    place, run, first, last, bad = None, 0, None, None, None

    def done() -> pa.RecordBatch:
        row = [*place, run, first, last, *(bad or (None, None))]
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    for batch in batches:
        files, blocks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for at, end in itertools.pairwise([0, *cuts.tolist(), len(batch)] if len(batch) else []):
            here, keys = (int(files[at]), int(blocks[at])), batch.column(2).slice(at, end - at)
            if here != place:
                if place is not None:
                    yield done()
                place, run, first, last, bad = here, run + 1, keys[0].as_py(), keys[0].as_py(), None
            if bad is None:
                before = pa.concat_arrays([pa.array([last], keys.type), keys.slice(0, len(keys) - 1)])
                falls = pc.index(pc.less(keys, before), pa.scalar(True)).as_py()
                if falls >= 0:
                    bad = before[falls].as_py(), keys[falls].as_py()
            last = keys[-1].as_py()
    if place is not None:
        yield done()


def unsorted_lines(df: DataFrame, key: str = "line") -> DataFrame:
    """(file_idx, block, prev, line): the first line out of order of each split that has one, or between two splits.

    df comes from a line source: (file_idx, block, seq) with the rows of a split in their order. Neighbours
    are compared as a split is read; then only the splits' first and last lines meet.
    """
    schema = "file_idx int, block bigint, run int, first binary, last binary, prev binary, line binary"
    splits = df.select("file_idx", "block", F.col(key).cast("binary").alias("key")).mapInArrow(_splits, schema)
    over = Window.partitionBy("file_idx").orderBy("block", "run")
    edges = splits.withColumn("_before", F.lag("last").over(over)).withColumn("_falls", F.col("_before") > F.col("first"))
    found = edges.withColumn("prev", F.when(F.col("_falls"), F.col("_before")).otherwise(F.col("prev"))).withColumn("line", F.when(F.col("_falls"), F.col("first")).otherwise(F.col("line")))
    return found.filter("line is not null").select("file_idx", "block", "prev", "line")


def require_sorted(df: DataFrame, key: str = "line") -> DataFrame:
    """The input; raises on the first line out of order, naming both lines."""
    bad = unsorted_lines(df, key).orderBy("file_idx", "block").limit(1).collect()
    if bad:
        raise ValueError(f"not sorted: {bytes(bad[0]['prev'])!r} stands before {bytes(bad[0]['line'])!r}")
    return df
