"""Connected components of a graph of ids, by joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesets.llm._common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (larger ones, or itself and those not larger) move to its smallest one.

    The smallest neighbour is combined before the shuffle and joined back, so a
    node with most of the edges is split like any skewed key.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    joined = both.join(least, "a")
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(least.select("a", F.col("low").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each id of an edge (a, b) is connected with.

    Large-star and small-star rounds; each round's edges are written to the
    shared folder. Ends when a round changes nothing: all edges then point at their
    component's smallest id.
    """
    now = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    facts = _facts(now)
    for _ in range(most_rounds):
        if not facts[0]:
            break
        after = materialize(_star(_star(now, True), False), "edges")
        new = _facts(after)
        discard(now)
        now = after
        if new == facts:
            break
        facts = new
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    ).groupBy("id").agg(F.min("component").alias("component"))


def _facts(edges: DataFrame) -> tuple:
    """Changes whenever the set of edges does."""
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), "a", "b"))
    ).first()
    return tuple(row)
