"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards. A key descends from the root: at each
level every child draws ln(u) / weight with u in (0, 1) from a hash of the key
and the child's name, and the largest draw wins, so a child gets keys in
proportion to its weight, and a change of one child's weight moves keys only
into it (if it grows) or out of it (if it shrinks). Movement stays in the
subtrees whose weights change.

grow() adds a shard as a region of its own: no other weight changes, at any
level, so the new shard takes rows only into itself.

Law: key. doc_id and the tree alone decide; a null doc_id is a key like any
other; rows with equal doc_id share a shard. Null texts count no bytes, and texts of any length only
their size. Of equal draws the later child wins. An empty table gives no rows; assign() adds one column and
keeps the others, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGIONS, RACKS, SHARDS = 2, 3, 4  # 24 shards


@dataclass(frozen=True)
class Node:
    """name must be unique in the tree; a leaf has a shard number."""

    name: str
    weight: float = 1.0
    shard: int | None = None
    children: tuple[Node, ...] = field(default_factory=tuple)

    def total(self) -> float:
        return sum(c.total() for c in self.children) if self.children else self.weight


def build(regions: int = REGIONS, racks: int = RACKS, shards: int = SHARDS) -> Node:
    number = iter(range(regions * racks * shards))
    return Node(
        "root",
        children=tuple(
            Node(f"r{r}", children=tuple(Node(f"r{r}.k{k}", children=tuple(Node(f"r{r}.k{k}.s{s}", shard=next(number)) for s in range(shards))) for k in range(racks)))
            for r in range(regions)
        ),
    )


def leaves(tree: Node) -> list[Node]:
    return [x for c in tree.children for x in leaves(c)] if tree.children else [tree]


def grow(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and a rack of its own."""
    n, r = len(leaves(tree)), f"r{len(tree.children)}"
    new = Node(r, children=(Node(f"{r}.k0", children=(Node(f"{r}.k0.s0", weight, shard=n),)),))
    return Node(tree.name, children=(*tree.children, new))


def _table(tree: Node) -> tuple[Column, Column, int]:
    """Children of each node and shard of each leaf, by node number, and the depth; a leaf is its own child."""
    nodes, depth, level = [tree], 0, [tree]
    while any(n.children for n in level):
        level = [c for n in level for c in n.children if c.total() > 0]
        nodes += level
        depth += 1
    number = {n.name: i for i, n in enumerate(nodes)}
    if len(number) < len(nodes):
        raise ValueError("node names must be unique")

    def entry(n: Node) -> Column:
        return F.struct(F.lit(number[n.name]).alias("id"), F.lit(n.name).alias("name"), F.lit(float(n.total())).alias("weight"))

    children = F.array(*[F.array(*[entry(c) for c in n.children if c.total() > 0] or [entry(n)]) for n in nodes])
    return children, F.array(*[F.lit(-1 if n.shard is None else n.shard) for n in nodes]), depth


def draw(key: Column, name: Column, weight: Column) -> Column:
    """ln(u) / weight, u from 53 bits of the hash of the key and the node's name."""
    bits = F.shiftrightunsigned(F.xxhash64(F.concat_ws(":", key, name)), 11).cast("double")
    return F.log((bits + 0.5) / F.lit(float(1 << 53))) / weight


def place(key: Column, tree: Node) -> Column:
    """Shard of a key: the child with the largest draw at each level (of equal draws the later child)."""
    children, shards, depth = _table(tree)
    at = F.lit(0)
    for _ in range(depth):
        options = F.element_at(children, at + 1)
        draws = F.transform(options, lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("draw"), c["id"].alias("id")))
        at = F.array_max(draws)["id"]
    return F.element_at(shards, at + 1)


def assign(docs: DataFrame, tree: Node, id_col: str = "doc_id", name: str = "shard") -> DataFrame:
    return docs.withColumn(name, place(F.col(id_col).cast("string"), tree))


def query(spark, sf_dir: str) -> DataFrame:
    from linesets.llm._common import result, scratch, table
    from linesets.llm._slots import with_slots

    tree = build()
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign(assign(docs, tree), grow(tree), name="grown_shard")
    with scratch(spark):
        out = with_slots(placed, "shard", "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
        path = result(out, "shards")
    return spark.read.schema(out.schema).parquet(path)


#: The columns that the tree doesn't decide.
SIZE_SQL = "select doc_id, octet_length(encode(coalesce(text, ''))) + 8 as size, 'key' as law from documents"
