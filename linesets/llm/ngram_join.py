"""N-gram Jaccard join by count-vector R-trees.

A document's set holds the hashes of its distinct 5-word shingles. Two documents
link when 100 * |A and B| >= 75 * |A or B|, that is when the overlap is at least
75 * (|A| + |B|) / 175.

* Tokens of a set are hashed into groups and the group counts are a point. The
  overlap of two sets can't exceed the sum over groups of the smaller count. An
  R-tree over points bounds a whole node by the largest count it holds in each
  group, so nodes and then single pairs whose bound is too small are left out;
  what survives is verified on the exact sets.
* One R-tree over a corpus would meet nearly every node with nearly every query,
  since long texts fill all groups alike. So trees are built over neighbourhoods
  that cannot lose a link: of a set in any one fixed order, two linked sets share
  one of the first |A| - ceil(0.75 |A|) + 1 tokens. The order puts rare tokens
  first, by counts of all tokens in 2^20 cells, so passages that many documents
  share come last. The least set that has a token in that part is the token's pivot,
  and a neighbourhood is a pivot with all sets that share such a token with it:
  sets that meet in a token meet in the neighbourhood of its pivot.
* A neighbourhood first meets as points alone: one tree tells which sets may have
  a partner at all, and only their tokens are fetched. One of more than `TREE_ROWS` sets would
  hold up a task; it goes on whole, and its trees are those of its blocks.
* Inside a neighbourhood only pairs that are not connected yet are looked at, so a
  group of copies costs its size, not its square. A large neighbourhood is dealt
  to blocks, the more the larger it is, each with the pivot; sets that a block could not connect to
  the pivot are then compared with all other blocks.
* Equal sets are one: they collapse before the join, and links are edges between
  numbers of sets. Components come from rounds of joins; doc_ids come in at the end.

A cell that holds far more than its share of the tokens would fill one bucket: its tokens
take another road to their pivots, as plain rows that are aggregated before they are shuffled.

Words and shingles are 64-bit hashes under a key that is drawn for each run, so texts
can't be made to collide; two sets of m shingles share one by chance in m^2 / 2^64 of
cases, and a false link needs three quarters of them.

Null texts, and texts without words, have empty sets and link with nothing; fewer
than 5 words are one shingle. Rows that repeat a doc_id are one document of each
text: their sets are linked with each other. A null doc_id links like others but can't
be smallest where another is there; a component of null ids alone is null. An empty table
gives no rows. A text's whole set is held by one worker, 8 bytes a shingle, however long the text is.
Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesets.llm import _text
from linesets.llm._common import materialize, result, scratch, table, tidy, with_workers
from linesets.llm._components import components

SHINGLE = 5
SHARE, WHOLE = 75, 100
CELL_BITS = 20
EARLY = np.uint32(1 << 31)  # marks the size of an early token's set
#: Rows of cells that are added up together.
CELL_PARTS = 256
#: A cell is hot from so many tokens on, if it also has so many times its share.
HOT_CELL, HOT_TIMES = 600_000, 64
BUCKET_TOKENS = 600_000
#: From so many buckets on both their number and their size grow; a bucket is worked on slot by slot.
WIDE = 4096
FLUSH = 400_000
#: Tokens and sets of a block at most, about.
BLOCK_TOKENS, BLOCK_SETS = 3_000_000, 20_000
#: Sets of a neighbourhood whose vectors one tree holds before tokens are fetched; larger ones are dealt to
#: the square root of so many sets' blocks.
TREE_ROWS, SPREAD = 1000, 64
FAN = 16
#: Sets that may be sent to every executor for the search of candidates' texts (8 bytes each); more meet in a join.
BROADCAST_IDS = 500_000

# sets --------------------------------------------------------------------------------------


def shingle_sets(part: list[bytes], key: int = _text.KEY, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    found = _text.words(part, key=key)
    n = np.diff(found.first)
    hashes = found.hash
    if len(hashes) >= size:
        runs = _text.chained([hashes[i : len(hashes) - size + 1 + i] for i in range(size)])
    out = []
    for begin, count in zip(found.first[:-1].tolist(), n.tolist(), strict=True):
        if count >= size:
            out.append(_distinct(runs[begin : begin + count - size + 1]))
        elif count:
            out.append(_text.chained([np.array([count], np.uint64), *(hashes[begin + i : begin + i + 1] for i in range(count))]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """96 bits that stand for a set: sums of two hashes of its tokens."""
    with np.errstate(over="ignore"):
        high = _text.mix(tokens + _text.STEP).sum(dtype=np.uint64)
        low = _text.mix(tokens ^ _text.BASE).sum(dtype=np.uint64) >> np.uint64(32)
    return int(high.astype(np.int64)), int(low)


def prefix_length(n: int) -> int:
    return n - -(-SHARE * n // WHOLE) + 1


def needed(a, b):
    """Least overlap of two linked sets of these sizes."""
    return -(-SHARE * (a + b) // (SHARE + WHOLE))


def cell_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def prefix(tokens: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first tokens of a set in the order of cell counts, then hashes; which of them are early).

    Of two linked sets the smaller one has their first common token among its
    early ones, and so have both if they are equally large.
    """
    n = len(tokens)
    rank = cells[cell_of(tokens)].astype(np.int64) * n + np.arange(n)  # tokens are sorted
    order = np.argsort(rank)[: prefix_length(n)]
    return tokens[order], np.arange(len(order)) <= n - needed(n, n)


# first pass: set of each document, counts of cells -------------------------------------------


def _describe(key: int):
    names = ["doc_id", "hash", "high", "low", "n", "vector", "part", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            rows: list[tuple[int, int, int, bytes]] = []
            for _, part in _text.slices(_text.texts(batch.column(1))):
                sets = shingle_sets(part, key)
                rows += [(*signature(s), len(s), count_vectors([s], groups_for(len(s)))[0].tobytes()) for s in sets]
                cells += np.bincount(cell_of(np.concatenate(sets)), minlength=1 << CELL_BITS)
            high, low, n, vector = zip(*rows, strict=True) if rows else ((), (), (), ())
            found = [pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(n, pa.int64()), pa.array(vector, pa.binary())]
            columns = [batch.column(0), batch.column(2), *found, pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        parts = [(i, x.tobytes()) for i, x in enumerate(cells.astype(np.uint32).reshape(CELL_PARTS, -1)) if x.any()]
        where, blobs = zip(*parts, strict=True) if parts else ((), ())
        empty = [pa.nulls(len(parts), pa.int64())] * 5
        yield pa.RecordBatch.from_arrays([*empty, pa.nulls(len(parts), pa.binary()), pa.array(where, pa.int32()), pa.array(blobs, pa.binary())], names=names)

    return run


def _add_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, counts of a task) sorted by part -> sums."""
    key, total = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "cells"])

    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if part != key:
                if key is not None:
                    yield row()
                key, total = part, np.zeros((1 << CELL_BITS) // CELL_PARTS, np.int64)
            total += np.frombuffer(blob.as_buffer(), np.uint32)
    if key is not None:
        yield row()


# second pass: tokens of each prefix, to the least set that has them ---------------------------


def _prefix_rows(cells: np.ndarray, hot: np.ndarray, n: int, slots: int, key: int):
    """(bucket, slot, token, high, low, n) rows of packed arrays. Tokens of hot cells go to buckets from n on, by task."""

    def flush(held: list[tuple], part: int) -> pa.RecordBatch:
        tokens = np.concatenate([h[0] for h in held])
        sizes = [len(h[0]) for h in held]
        highs = np.repeat(np.array([h[1][0] for h in held], np.int64), sizes)
        lows = np.repeat(np.array([h[1][1] for h in held], np.uint32), sizes)
        counts = np.concatenate([np.where(h[3], EARLY, np.uint32(0)) | np.uint32(h[2]) for h in held])
        slot = ((_text.mix(tokens) >> np.uint64(32)) * np.uint64(n * slots) >> np.uint64(32)).astype(np.int64)
        slot = np.where(hot[cell_of(tokens)], (n + part % n) * slots, slot)
        order = np.argsort(slot, kind="stable")
        edges = np.flatnonzero(np.diff(slot[order], prepend=-1))
        ends = [*edges[1:].tolist(), len(order)]
        cut = lambda a: pa.array([a[order[s:e]].tobytes() for s, e in zip(edges.tolist(), ends, strict=True)], pa.binary())
        bucket, inner = np.divmod(slot[order][edges], slots)
        where = [pa.array(bucket, pa.int32()), pa.array(inner, pa.int32())]
        return pa.RecordBatch.from_arrays([*where, cut(tokens), cut(highs), cut(lows), cut(counts)], names=["bucket", "slot", "token", "high", "low", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held, size, seen = TaskContext.get().partitionId(), [], 0, set()
        for batch in batches:
            for _, part in _text.slices(_text.texts(batch.column(0))):
                for s in shingle_sets(part, key):
                    if not len(s):
                        continue
                    own = signature(s)
                    if own in seen:  # an equal set of this flush
                        continue
                    seen.add(own)
                    first, early = prefix(s, cells)
                    held.append((first, own, len(s), early))
                    size += len(held[-1][0])
                    if size >= FLUSH:
                        yield flush(held, task)
                        held, size, seen = [], 0, set()
        if held:
            yield flush(held, task)

    return run


def _pivots(n: int):
    """Rows (token, high, low, p_high, p_low): of tokens that two sets have, each set with its pivot; token is null.

    Tokens of hot cells pass through, with the token and no pivot.
    """
    names = ["token", "high", "low", "p_high", "p_low"]

    def batch_of(token, high, low, p_high, p_low) -> pa.RecordBatch:
        m = len(high)
        arrays = [pa.nulls(m, pa.int64()) if x is None else pa.array(x.astype(np.int64)) for x in (token, high, low, p_high, p_low)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def heads_of(tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
        # no set is linked with one over a third larger, so a gap in the sizes parts a token's sets
        apart = (tokens[1:] != tokens[:-1]) | (SHARE * size[1:] > WHOLE * size[:-1])
        return np.flatnonzero(np.concatenate([[True], apart]))

    def shared(tokens, high, low, size) -> pa.RecordBatch:
        early, size = size >= EARLY, (size & ~EARLY).astype(np.int64)
        order = np.lexsort((low, high, size, tokens))
        tokens, high, low, size, early = tokens[order], high[order], low[order], size[order], early[order]
        # an equal set that came from another task is the same member
        again = np.concatenate([[False], (tokens[1:] == tokens[:-1]) & (high[1:] == high[:-1]) & (low[1:] == low[:-1])])
        tokens, high, low, size, early = tokens[~again], high[~again], low[~again], size[~again], early[~again]
        # a set that isn't early can only be the larger one
        heads = heads_of(tokens, size)
        least = np.minimum.reduceat(np.where(early, size, np.iinfo(np.int64).max), heads)
        use = early | (size > np.repeat(least, np.diff(np.concatenate([heads, [len(tokens)]]))))
        tokens, high, low, size = tokens[use], high[use], low[use], size[use]
        if not len(tokens):
            return batch_of(None, *[np.empty(0, np.int64)] * 4)
        heads = heads_of(tokens, size)
        members = np.diff(np.concatenate([heads, [len(tokens)]]))
        first = np.repeat(heads, members)
        many = np.repeat(members > 1, members)
        pairs = np.column_stack([high, low, high[first], low[first]])[many]
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
        return batch_of(None, *pairs.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                arrays = [np.frombuffer(b, d) for b, d in zip(row[2:], (np.uint64, np.int64, np.uint32, np.uint32), strict=True)]
                if row[0] >= n:
                    yield batch_of(*arrays[:3], None, None)
                    continue
                if row[:2] != key and held:
                    yield shared(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
                key = row[:2]
                held.append(arrays)
        if held:
            yield shared(*map(np.concatenate, zip(*held, strict=True)))

    return run


# neighbourhoods: R-tree, bounds, exact sets ---------------------------------------------------


class RTree:
    """Over count vectors, packed by size and then by the heaviest group; every node holds the largest counts below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = FAN):
        self.points, self.sizes, self.fan = points, sizes, fan
        # sets of one size and shape are near each other
        self.order = np.lexsort((points.argmax(axis=1), sizes)) if len(points) else np.empty(0, np.int64)
        tops, low = points[self.order], sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while len(tops) > 1:
            cuts = np.arange(0, len(tops), fan)
            tops, low = np.maximum.reduceat(tops, cuts), np.minimum.reduceat(low, cuts)
            self.levels.append((tops, low))

    def near(self, point: np.ndarray, size: int) -> np.ndarray:
        """Points whose overlap bound with a set allows a link."""
        nodes = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.order))
        for tops, low in reversed(self.levels):
            bound = np.minimum(tops[nodes], point).sum(axis=1, dtype=np.int64)
            nodes = nodes[bound >= needed(size, low[nodes])]
            nodes = (nodes[:, None] * self.fan + np.arange(self.fan)).ravel()
            below = len(self.order) if tops is self.levels[0][0] else len(self.levels[[t is tops for t, _ in self.levels].index(True) - 1][0])
            nodes = nodes[nodes < below]
        rows = self.order[nodes]
        bound = np.minimum(self.points[rows], point).sum(axis=1, dtype=np.int64)
        return rows[bound >= needed(size, self.sizes[rows])]


def groups_for(size: int) -> int:
    """Groups, a power of two, that leave a set of this size a few tokens each."""
    return min(1 << 14, max(16, 1 << max(size // 4, 1).bit_length()))


def count_vectors(sets: list[np.ndarray], groups: int) -> np.ndarray:
    """Tokens of each set in each group; a group of half as many groups holds those of two."""
    sizes = [len(s) for s in sets]
    where = np.repeat(np.arange(len(sets)), sizes) * groups + (np.concatenate(sets) & np.uint64(groups - 1)).astype(np.int64)
    return np.bincount(where, minlength=len(sets) * groups).reshape(len(sets), groups).astype(np.uint16)


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    return vector.reshape(-1, groups).sum(axis=0, dtype=np.uint32) if len(vector) > groups else vector.astype(np.uint32)


def paired(vectors: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Which sets have a partner that the bound lets through."""
    groups = min(map(len, vectors))
    points = np.stack([folded(v, groups) for v in vectors])
    tree = RTree(points, sizes)
    known = np.zeros(len(vectors), bool)
    for i in range(len(vectors)):
        if not known[i]:
            near = tree.near(points[i], int(sizes[i]))
            if len(near) > 1:  # itself and another
                known[near] = True
    return known


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common tokens of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def connect(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that connect whatever is connected among sets (the first is the pivot).

    With others: links between a set and the others, as (set, other), one for each component of
    the others; sets stay apart from each other then.
    """
    base = sets if others is None else others
    sizes = np.array([len(s) for s in base])
    groups = groups_for(int(sizes.min()))
    points = count_vectors(base, groups)
    tree = RTree(points, sizes)
    parent, groups_left = list(range(len(base))), len(base)
    edges = []
    if others is not None:  # a link with one of a component is a link with all
        for i, j in connect(others):
            parent[_find(parent, i)] = _find(parent, j)
    asked = range(len(base)) if others is None else range(len(sets))
    vectors = points if others is None else count_vectors(sets, groups)
    for i in asked:
        mine = sets[i]
        near = tree.near(vectors[i], len(mine))
        if others is None:
            near = near[near > i]
        near.sort()
        met: set[int] = set()
        for j in near.tolist():
            root = _find(parent, j)
            if root in met or others is None and _find(parent, i) == root:
                continue
            if overlap(mine, base[j]) >= needed(len(mine), sizes[j]):
                edges.append((i, j))
                if others is None:
                    parent[_find(parent, i)] = root
                    groups_left -= 1
                else:
                    met.add(root)
        if others is None and groups_left == 1:
            break
    return edges


def _find(parent: list[int], x: int) -> int:
    """Root of x in a forest; the way there gets shorter."""
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pivot, id, n, blocks, vector) sorted by pivot -> those of sets that may have a partner, and their pivots."""

    def kept() -> pa.RecordBatch:
        use = paired([np.frombuffer(r[3], np.uint16) for r in held], np.array([r[1] for r in held]))
        if use.any():
            use |= np.array([r[0] == key for r in held])
        rows = [held[i] for i in np.flatnonzero(use)]
        columns = [[key] * len(rows), *([r[k] for r in rows] for k in range(3))]
        kinds = [*[pa.int64()] * 3, pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["pivot", "id", "n", "blocks"])

    key, held = None, []
    for batch in batches:
        for pivot, *row in zip(*(batch.column(n).to_pylist() for n in ("pivot", "id", "n", "blocks", "vector")), strict=True):
            if pivot != key:
                if len(held) > 1:
                    yield kept()
                key, held = pivot, []
            held.append(row)
    if len(held) > 1:
        yield kept()


def _neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pivot, block, id, tokens) sorted by pivot, block -> edges (a, b), and members apart from the pivot (loose)."""

    def solve(key: tuple[int, int], ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] != key[0], ids[i]))
        ids, sets = [ids[i] for i in order], [sets[i] for i in order]
        edges = connect(sets)
        parent = list(range(len(ids)))
        for i, j in edges:
            parent[_find(parent, i)] = _find(parent, j)
        root = _find(parent, 0)
        loose = [ids[i] for i in range(len(ids)) if _find(parent, i) != root]
        a = [ids[i] for i, _ in edges] + loose
        b = [ids[j] for _, j in edges] + [None] * len(loose)
        m = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * m, pa.int64()), pa.array([key[1]] * m, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["pivot", "block", "a", "b"]
        )

    key, ids, sets = None, [], []
    for batch in batches:
        for pivot, block, doc, blob in zip(*(batch.column(n).to_pylist() for n in ("pivot", "block", "id", "tokens")), strict=True):
            if (pivot, block) != key:
                if len(ids) > 1:
                    yield solve(key, ids, sets)
                key, ids, sets = (pivot, block), [], []
            ids.append(doc)
            sets.append(np.frombuffer(blob, np.uint64))
    if len(ids) > 1:
        yield solve(key, ids, sets)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pivot, block, id, tokens, own block or null) sorted so that a block's own sets come first -> edges."""
    key, ids, sets, asking = None, [], [], []

    def solve() -> pa.RecordBatch:
        edges = connect([s for _, s in asking], sets) if ids and asking else []
        a, b = [asking[i][0] for i, _ in edges], [ids[j] for _, j in edges]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for pivot, block, visits, doc, blob in zip(*(batch.column(n).to_pylist() for n in ("pivot", "block", "visits", "id", "tokens")), strict=True):
            if (pivot, block) != key:
                if asking:
                    yield solve()
                key, ids, sets, asking = (pivot, block), [], [], []
            if visits:
                asking.append((doc, np.frombuffer(blob, np.uint64)))
                if sum(len(s) for _, s in asking) > BLOCK_TOKENS:
                    yield solve()
                    asking = []
            else:
                ids.append(doc)
                sets.append(np.frombuffer(blob, np.uint64))
    if asking:
        yield solve()


def _sets_of(key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, part in _text.slices(_text.texts(batch.column(0))) for s in shingle_sets(part, key)]
            high, low = zip(*map(signature, sets), strict=True) if sets else ((), ())
            columns = [pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["high", "low", "tokens"])

    return run


# the join ----------------------------------------------------------------------------------


def describe(docs: DataFrame, key: int) -> tuple[DataFrame, np.ndarray]:
    """((doc_id, hash of the text, high, low, n, vector) of every document, counts of cells)."""
    schema = "doc_id bigint, hash bigint, high bigint, low bigint, n bigint, vector binary, part int, cells binary"
    first = materialize(docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(tidy(_describe(key)), schema), "shingle-sets")
    # 2^20 counts a task in parts, each part added up by a task of its own; the sums are a bounded array, however many documents
    parts = first.filter("cells is not null").select("part", "cells").repartition(CELL_PARTS, "part").sortWithinPartitions("part")
    cells = np.zeros((CELL_PARTS, (1 << CELL_BITS) // CELL_PARTS), np.int64)
    for r in parts.mapInArrow(tidy(_add_cells), "part int, cells binary").collect():
        cells[r["part"]] = np.frombuffer(r["cells"], np.int64)
    return first.filter("cells is null").drop("part", "cells"), cells.ravel()


def memberships(docs: DataFrame, cells: np.ndarray, key: int) -> DataFrame:
    """(high, low, p_high, p_low), distinct: sets with the pivots whose neighbourhoods they belong to."""
    units = -(-int(cells.sum()) // 4 // BUCKET_TOKENS)
    n = max(8, units if units <= WIDE else math.isqrt(WIDE * units))
    slots = max(1, -(-units // n))
    hot = cells > max(HOT_CELL, HOT_TIMES * int(cells.sum()) >> CELL_BITS)
    order = np.minimum(cells, 0xFFFFFFFF).astype(np.uint32)  # an order is all they give
    rows = docs.select("text").mapInArrow(tidy(_prefix_rows(order, hot, n, slots, key)), "bucket int, slot int, token binary, high binary, low binary, n binary")
    # a bucket is a partition, so none holds several by chance
    dealt = rows.repartitionById(2 * n if hot.any() else n, "bucket").sortWithinPartitions("bucket", "slot")
    found = materialize(dealt.mapInArrow(tidy(_pivots(n)), "token bigint, high bigint, low bigint, p_high bigint, p_low bigint"), "pivots")
    members = found.filter("token is null").drop("token")
    if hot.any():
        plain = found.filter("token is not null").select("token", "high", "low").distinct()
        least = plain.groupBy("token").agg(F.min(F.struct("high", "low")).alias("p"), F.count(F.lit(1)).alias("m")).filter("m > 1")
        members = members.unionByName(plain.join(least, "token").select("high", "low", F.col("p.high").alias("p_high"), F.col("p.low").alias("p_low")))
    return members.distinct()


def _pruned(pairs: DataFrame, described: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, id, n, blocks): members that may have a partner by the bound on count vectors, and how many blocks they are dealt to."""
    counted = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("weight")).filter("m > 1")
    many = F.when(F.col("m") > TREE_ROWS, F.sqrt(F.col("m") / SPREAD)).otherwise(1)
    blocks = F.ceil(F.greatest(many, F.col("weight") / BLOCK_TOKENS, F.col("m") / BLOCK_SETS)).cast("int")
    sized = pairs.join(counted.select("pivot", "m", blocks.alias("blocks")), "pivot")
    # of rows with one set, the one with its least doc_id
    own, least = described.alias("d"), sets.alias("s")
    same = (F.col("d.high") == F.col("s.high")) & (F.col("d.low") == F.col("s.low")) & F.col("d.doc_id").eqNullSafe(F.col("s.rep"))
    vectors = own.join(least, same).select("s.id", "d.vector")
    vectors = vectors.groupBy("id").agg(F.min("vector").alias("vector"))
    few = sized.filter(F.col("m") <= TREE_ROWS).select("pivot", "id", "n", "blocks").join(vectors, "id").select("pivot", "id", "n", "blocks", "vector")
    dealt = few.repartition("pivot").sortWithinPartitions("pivot")
    kept = dealt.mapInArrow(tidy(_bounded), "pivot bigint, id bigint, n bigint, blocks int")
    whole = sized.filter(F.col("m") > TREE_ROWS).select("pivot", "id", "n", "blocks")
    return materialize(kept.unionByName(whole), "near-members")


def distinct_sets(described: DataFrame) -> DataFrame:
    """(high, low, rep, n, id) of each set: rep is its least doc_id, null if all are; id is a number."""
    sets = described.filter("n > 0").groupBy("high", "low").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    return materialize(sets.withColumn("id", F.monotonically_increasing_id()), "sets")


def repeated_ids(described: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between sets that one doc_id has."""
    slim = described.filter("n > 0 and doc_id is not null").select("doc_id", F.struct("high", "low").alias("own"))
    several = slim.groupBy("doc_id").agg(F.min("own").alias("least"), F.max("own").alias("most")).filter("least < most")
    held = slim.join(several.select("doc_id"), "doc_id").distinct().select("doc_id", "own.*").join(sets.select("high", "low", "id"), ["high", "low"])
    least = held.groupBy("doc_id").agg(F.min("id").alias("a"))
    return held.join(least, "doc_id").select("a", F.col("id").alias("b")).filter("a <> b")


def links(docs: DataFrame, described: DataFrame, sets: DataFrame, cells: np.ndarray, key: int) -> DataFrame:
    """(a, b): links between sets that connect all that is linked."""
    members = memberships(docs, cells, key)
    named = members.join(sets, ["high", "low"]).select("id", "n", F.col("p_high").alias("high"), F.col("p_low").alias("low"))
    pairs = named.join(sets.select("high", "low", F.col("id").alias("pivot")), ["high", "low"]).select("pivot", "id", "n")
    pairs = _pruned(materialize(pairs, "members"), described, sets)
    # blocks of a neighbourhood hold a bounded number of tokens; the pivot is in each of them
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    placed = pairs.select("pivot", "id", "blocks", F.explode(F.when(F.col("id") == F.col("pivot"), every).otherwise(F.array(own))).alias("block"))
    ids = materialize(pairs.select("id").distinct().join(sets.select("id", "rep", "high", "low"), "id"), "candidates")
    small = ids.count() <= BROADCAST_IDS
    reps = ids.select("rep").distinct()
    wanted = docs.join(F.broadcast(reps) if small else reps, docs["doc_id"].eqNullSafe(reps["rep"]), "left_semi").select("text")
    # a doc_id may have other texts too: the signature tells which set is wanted
    tokens = wanted.mapInArrow(tidy(_sets_of(key)), "high bigint, low bigint, tokens binary").join(ids.select("high", "low", "id"), ["high", "low"])
    tokens = materialize(tokens.groupBy("high", "low", "id").agg(F.min("tokens").alias("tokens")).select("id", "tokens"), "candidate-sets")
    full = placed.join(tokens, "id").select("pivot", "block", "blocks", "id", "tokens")
    solved = full.repartition("pivot", "block").sortWithinPartitions("pivot", "block")
    found = materialize(solved.select("pivot", "block", "id", "tokens").mapInArrow(tidy(_neighbourhoods), "pivot bigint, block int, a bigint, b bigint"), "links")
    edges = found.filter("b is not null").select("a", "b")
    large = pairs.filter("blocks > 1 and id = pivot").select("pivot", "blocks")
    if large.limit(1).count():
        loose = found.filter("b is null").select("pivot", F.col("block").alias("home"), F.col("a").alias("id")).join(large, "pivot")
        visit = loose.select("pivot", "id", "home", F.explode(every).alias("block")).filter("block <> home").join(tokens, "id")
        there = full.filter("blocks > 1").select("pivot", "block", F.lit(False).alias("visits"), "id", "tokens")
        both = there.unionByName(visit.select("pivot", "block", F.lit(True).alias("visits"), "id", "tokens"))
        met = both.repartition("pivot", "block").sortWithinPartitions("pivot", "block", "visits")
        edges = edges.unionByName(met.mapInArrow(tidy(_across), "a bigint, b bigint"))
    return edges.unionByName(repeated_ids(described, sets))


def grouped(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, hash of the text, n_shingles, component, component_id) of every row; component is a number, null without words."""
    spark = docs.sparkSession
    with_workers(spark)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    key = secrets.randbits(64)
    with scratch(spark):
        described, cells = describe(slim, key)
        sets = distinct_sets(described)
        joined = components(links(slim, described, sets, cells, key))
        least = joined.join(sets.select("id", "rep"), "id").groupBy("component").agg(F.min("rep").alias("least"))
        named = sets.join(joined, "id", "left").join(least, "component", "left")
        named = named.select("high", "low", F.coalesce("component", "id").alias("component"), F.coalesce("least", "rep").alias("component_id"))
        linked = described.filter("n > 0").join(named, ["high", "low"])
        alone = described.filter("n = 0").withColumns({"component": F.lit(None).cast("bigint"), "component_id": F.col("doc_id")})
        names = ["doc_id", "hash", F.col("n").alias("n_shingles"), "component", "component_id"]
        path = result(linked.select(*names).unionByName(alone.select(*names)), "classes")
    return spark.read.schema("doc_id bigint, hash bigint, n_shingles bigint, component bigint, component_id bigint").parquet(path)


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return grouped(docs, text, id_col).select("doc_id", "n_shingles", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
    select distinct doc_id, shingle from (
        select doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as shingle from d where len(w) >= 5
        union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 4)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 75 * (x.n + y.n - c)),
both_ways as (select a, b from e union all select b, a from e),
r as (select a as id, b as other from both_ways union select r.id, both_ways.b from r join both_ways on r.other = both_ways.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) as component_id
from d left join n on d.doc_id = n.doc_id left join r on d.doc_id = r.id group by d.doc_id, n.n
"""
assert (SHINGLE, SHARE, WHOLE) == (5, 75, 100)  # as the SQL has them
