"""Exact top-k search by inner product with vector-approximation files.

Vectors become integers, floor(scale * x), and stand in two files. The exact file has a row
for each vector. The approximation file has blocks of vectors with one byte for each component:
the cell it falls in, of 256 cells of equal width between the block's least and largest
component of that dimension. It is a fraction of the exact one.

* Copies. Of equal vectors only those of the k + 1 smallest ids can be found, so a group of copies of any size
  is a few rows of both files.
* Scan. Cells of equal width make a bound cheap: the score of the cells' middles is one matrix
  product of queries and cells, and no vector of these cells scores more or less than
  that by half a cell's width times the query's component, summed over dimensions, which is one
  number for a query and a block. A vector is a candidate if its upper bound isn't below the k-th
  largest lower bound.
* Read. The k candidates with the largest upper bounds are read from the exact file first. Their
  k-th best score is certain to be reached, so of the rest only those are read whose
  upper bound isn't below it; then the k-th result is certain.

Approximations are dealt to parts of bounded size. Queries, in blocks, pass by the cells of one
part at a time, so a worker holds one part and one block of queries; no side is broadcast, and of
each part only the candidates leave. Every query meets every vector, as a bound.

Rows whose vector is null or holds a null or non-finite component, or whose id is
null, take no part. A shorter vector counts as if zeros followed. A query's own
rows are those of its id. Of several rows with one query id, the least vector
asks. Rows repeated among the candidates are found as often as they stand there; ties go to
the smaller id. An empty table gives no rows. Only the id and the vector are read, so other
columns may have any name. Scores are 64-bit: components so large that a score might
not fit are an error, never a wrong score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linesets.llm._common import materialize, result, scratch, table, tidy, with_workers

K = 5
SCALE = 256
EVERY = 50
CELLS = 256
BLOCK_ROWS = 4096
#: Vectors of a part, about, that a worker holds as cells, and queries that pass by together.
PART_ROWS = 1 << 18
QUERY_ROWS = 512
LARGEST = float(1 << 62)


# the two files -------------------------------------------------------------------------------


def integers(df: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, v): the vectors that take part, as integers."""
    v = F.col(vector).cast("array<double>")
    clean = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(x * scale).cast("double"), F.lit(LARGEST)), F.lit(-LARGEST)).cast("bigint"))
    return df.filter(clean).select(F.col(id_col).cast("bigint").alias("id"), whole.alias("v"))


def foremost(whole: DataFrame, k: int) -> DataFrame:
    """Rows that some query may find: of equal vectors those of the k + 1 smallest ids, k of each.

    Equal vectors have equal scores, so ids alone decide between them, and a query leaves out one id, its own. Both
    limits prune before the shuffle, so a vector with most of the rows is a few rows a task.
    """
    alike = F.row_number().over(Window.partitionBy("v", "id").orderBy("id"))
    few = whole.withColumn("n", alike).filter(F.col("n") <= k).drop("n")
    return few.withColumn("n", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1).drop("n")


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of integers as rows, zeros at the end."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def approximate(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell of each component, least component and cell width by dimension)."""
    low = exact.min(axis=0).astype(np.float64)
    width = np.maximum((exact.max(axis=0).astype(np.float64) - low + 1) / CELLS, np.abs(low) * 1e-12 + 1e-9)
    return np.clip((exact - low) // width, 0, CELLS - 1).astype(np.uint8), low, width


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, id, v) -> blocks of cells."""
    names = ["rows", "ids", "cells", "low", "width"]
    for batch in batches:
        for at in range(0, len(batch), BLOCK_ROWS):
            some = batch.slice(at, BLOCK_ROWS)
            ids, rows = (some.column(c).to_numpy(zero_copy_only=False) for c in (1, 0))
            blobs = [x.tobytes() for x in (rows, ids, *approximate(matrix(some.column(2))))]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs], names=names)


BLOCKS = "rows binary, ids binary, cells binary, low binary, width binary"


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, v) -> blocks of queries: ids and integers of as few bytes as hold them."""
    for batch in batches:
        for at in range(0, len(batch), QUERY_ROWS):
            some = batch.slice(at, QUERY_ROWS)
            exact = matrix(some.column(1))
            small = exact.astype(np.min_scalar_type(-int(np.abs(exact).max(initial=1)) - 1))
            blobs = [some.column(0).to_numpy(zero_copy_only=False).tobytes(), small.tobytes()]
            arrays = [*(pa.array([b], pa.binary()) for b in blobs), pa.array([exact.shape[1]], pa.int32()), pa.array([small.dtype.str])]
            yield pa.RecordBatch.from_arrays(arrays, names=["asked", "wanted", "dims", "kind"])


# the scan ------------------------------------------------------------------------------------


def bounds(asked: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores of the cells' middles, queries by vectors; how far a true score may lie from them, by query)."""
    dims = min(asked.shape[1], cells.shape[1])
    q, low, width = asked[:, :dims].astype(np.float64), low[:dims], width[:dims]
    middle = (q * width) @ (cells[:, :dims].astype(np.float64) + 0.5).T
    middle += (q @ low)[:, None]
    # half a cell, and what rounding may have moved
    largest = np.abs(low) + CELLS * width
    return middle, np.abs(q) @ (width / 2 + largest * 1e-12 * (dims + 4)) + 1e-6


class Candidates:
    """Vectors that may be among the k best of each query, by bounds alone."""

    def __init__(self, ids: np.ndarray, asked: np.ndarray, k: int):
        self.ids, self.asked, self.k = ids, asked, k
        self.least = np.full((len(ids), k), -np.inf)  # the largest lower bounds so far
        self.found: list[tuple[np.ndarray, ...]] = []

    def scan(self, rows: np.ndarray, ids: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> None:
        middle, reach = bounds(self.asked, cells, low, width)
        own = np.flatnonzero(np.isin(self.ids, ids))
        for q in own.tolist():
            middle[q, ids == self.ids[q]] = -np.inf
        k = min(self.k, len(ids))
        best = np.partition(middle, len(ids) - k, axis=1)[:, len(ids) - k :] - reach[:, None]
        self.least = np.sort(np.concatenate([self.least, best], axis=1), axis=1)[:, -self.k :]
        q, at = np.nonzero(middle + reach[:, None] >= self.least[:, :1])
        use = np.isfinite(middle[q, at])
        q, at = q[use], at[use]
        self.found.append((q, rows[at], middle[q, at] + reach[q], middle[q, at] - reach[q]))

    def left(self) -> tuple[np.ndarray, ...]:
        """(query, row, upper, lower) of those that the bounds of later blocks left over."""
        q, rows, upper, lower = (np.concatenate(x) for x in zip(*self.found, strict=True))
        use = upper >= self.least[q, 0]
        return self.ids[q[use]], rows[use], upper[use], lower[use]


FOUND = "query_id bigint, row bigint, upper double, lower double"


def _scan(k: int):
    def left(part: list[tuple[np.ndarray, ...]], r: dict) -> pa.RecordBatch:
        ids = np.frombuffer(r["asked"], np.int64)
        best = Candidates(ids, np.frombuffer(r["wanted"], r["kind"]).reshape(len(ids), r["dims"]), k)
        for block in part:
            best.scan(*block)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in best.left()], names=["query_id", "row", "upper", "lower"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by part, the blocks of cells before the queries that pass by."""
        at, held = None, []
        for batch in batches:
            for i in range(len(batch)):
                r = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                if r["part"] != at:
                    at, held = r["part"], []
                if r["asked"] is not None:
                    if held:
                        yield left(held, r)
                    continue
                rows, ids, low, width = (np.frombuffer(r[c], d) for c, d in (("rows", np.int64), ("ids", np.int64), ("low", np.float64), ("width", np.float64)))
                held.append((rows, ids, np.frombuffer(r["cells"], np.uint8).reshape(len(ids), len(low)), low, width))

    return run


def scan(numbered: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """(query_id, row, upper, lower): candidates of each query by the approximation file."""
    blocks = materialize(numbered.select("row", "id", "v").mapInArrow(tidy(_blocks), BLOCKS), "va-cells")
    wanted = materialize(asking.mapInArrow(tidy(_asking), "asked binary, wanted binary, dims int, kind string"), "va-queries")
    rows = numbered.count()
    # smaller parts where there are fewer than tasks
    n = max(1, math.ceil(rows / PART_ROWS), min(math.ceil(rows / BLOCK_ROWS), numbered.sparkSession.sparkContext.defaultParallelism))
    own = blocks.select(F.pmod(F.xxhash64("rows"), F.lit(n)).cast("int").alias("part"), "*")
    guests = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"), "*")
    both = own.unionByName(guests, allowMissingColumns=True)
    # nulls first: what has no query is a block of cells
    met = both.repartition(n, "part").sortWithinPartitions("part", F.col("asked").isNotNull())
    return met.mapInArrow(tidy(_scan(k)), FOUND)


# exact scores --------------------------------------------------------------------------------


def score(a: Column, b: Column) -> Column:
    """Inner product of two arrays of integers; an error where it might not fit 64 bits."""
    most = lambda v: F.coalesce(F.array_max(F.transform(v, lambda x: F.abs(x))), F.lit(0)).cast("double")
    fits = most(a) * most(b) * F.least(F.size(a), F.size(b)) < 2.0**63
    # of arrays of unlike lengths the rest is null
    product = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.when(fits, product).otherwise(F.raise_error(F.lit("components are too large for 64-bit scores")))


def _best(rows: DataFrame, by: list, n: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).filter(F.col(name) <= n)


def read(found: DataFrame, numbered: DataFrame, asking: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) of candidates, from the exact file."""
    exact = found.select("query_id", "row").join(numbered.select("row", F.col("id").alias("vec_id"), "v"), "row")
    wanted = asking.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return exact.join(wanted, "query_id").select("query_id", "vec_id", score(F.col("q"), F.col("v")).alias("score"))


def search(df: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best others of each row whose id is divisible by `every`."""
    spark = df.sparkSession
    with_workers(spark)
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    with scratch(spark):
        whole = integers(df, id_col, vector, scale)
        numbered = materialize(foremost(whole, k).withColumn("row", F.monotonically_increasing_id()), "va-exact")
        asking = materialize(whole.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), "va-asking")
        found = materialize(scan(numbered, asking, k), "va-found")
        # over all parts: the k-th largest lower bound
        floor = _best(found, [F.desc("lower")], k).groupBy("query_id").agg(F.min("lower").alias("floor"), F.count(F.lit(1)).alias("n"))
        left = found.join(floor, "query_id").filter((F.col("n") < k) | (F.col("upper") >= F.col("floor")))
        left = materialize(left.withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "row"))).drop("floor", "n"), "va-left")
        first = materialize(read(left.filter(F.col("turn") <= k), numbered, asking), "va-first")
        sure = first.groupBy("query_id").agg(F.min("score").alias("sure"))
        # an upper bound that equals the k-th score may still win by its id
        rest = left.filter(F.col("turn") > k).join(sure, "query_id").filter(F.col("upper") >= F.col("sure"))
        scored = first.unionByName(read(rest, numbered, asking))
        path = result(_best(scored, [F.desc("score"), "vec_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "va-results")
    return spark.read.schema(schema).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = f"""
with e as (
    select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
    select q.vec_id as query_id, c.vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint as score
    from e q, e c where q.vec_id % {EVERY} = 0 and q.vec_id <> c.vec_id)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= {K}
"""
