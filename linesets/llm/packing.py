"""Best-fit packing of documents into sequences by exact-complement hashing.

Documents of one length are interchangeable, so packing works on the number of
pieces of each length: at most `capacity` counts, however many documents there
are. An index hashes the sums of one, two and three lengths. The longest length left
opens a sequence, and the gap is looked up among the sums; a combination that fills it
exactly is used as often as the counts allow. Where none does, the longest
length that fits (best fit) goes in and the smaller gap is looked up.

The plan says for ranges of ranks inside a length which sequences and offsets
they take; each piece finds its place from its length and its rank, so the
pieces never meet in one task.

Null texts are empty; an empty document is its end id alone. Only documents
longer than the capacity are cut; very long ones are coded in parts. Rows equal in everything are
packed twice; of equal lengths any may come first. An empty table gives no rows. Documents are read by
two columns, so others may have any name; pieces keep the columns they come with.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linesets.llm import _text, _tokens
from linesets.llm._common import result, scratch, table, tidy, with_workers
from linesets.llm._slots import with_slots

CAPACITY = 4096
END_ID = 1


class SumIndex:
    """Lengths with how many of each are left, and by their sum the pairs and triples of lengths, hashed.

    A bucket is made when its sum is first asked for: the largest length of every pair (or
    triple) with that sum, the largest last. Lengths only run out, so a combination that
    lacks one leaves its bucket for good; one that merely has a length in the sequence that is
    being filled is passed over.
    """

    def __init__(self, counts: Mapping[int, int], capacity: int):
        self.left = [0] * (capacity + 1)
        for n, c in counts.items():
            self.left[n] = c
        self.free = list(self.left)  # without the sequence that is being filled
        self.lengths = np.array(sorted(n for n, c in counts.items() if c > 0), np.int64)
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}

    def take(self, lengths: tuple[int, ...]) -> None:
        for n in lengths:
            self.free[n] -= 1

    def use(self, chosen: Mapping[int, int], times: int) -> None:
        """So many sequences of what was taken."""
        for n, c in chosen.items():
            self.left[n] -= c * times
            self.free[n] = self.left[n]
        gone = [n for n in chosen if not self.left[n]]
        if gone:
            self.lengths = self.lengths[~np.isin(self.lengths, gone)]

    def longest(self, most: int) -> int:
        """Longest free length up to most; 0 if there is none."""
        for i in range(int(np.searchsorted(self.lengths, most, side="right")) - 1, -1, -1):
            if self.free[self.lengths[i]] > 0:
                return int(self.lengths[i])
        return 0

    def _pairs(self, total: int) -> list[int]:
        """Larger lengths of the pairs with this sum that are left."""
        bucket = self.pairs.get(total)
        if bucket is None:
            larger = self.lengths[(2 * self.lengths >= total) & (self.lengths < total)]
            bucket = self.pairs[total] = larger[np.isin(total - larger, self.lengths)].tolist()
        return bucket

    def _left(self, a: int, b: int) -> bool:
        return self.left[a] > (a == b) and self.left[b] > 0

    def pair(self, total: int, beside: int = 0) -> tuple[int, int] | None:
        """The two free lengths of this sum that lie farthest apart, with one more beside them."""
        bucket, free, gone, found = self._pairs(total), self.free, 0, None
        for a in reversed(bucket):
            b = total - a
            if free[a] > (a == b) + (a == beside) and free[b] > (a == b) + (b == beside):
                found = a, b
                break
            gone += not self._left(a, b)
        if gone:
            bucket[:] = [a for a in bucket if self._left(a, total - a)]
        return found

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """Three free lengths of this sum, the largest as large as can be."""
        bucket = self.triples.get(total)
        if bucket is None:
            bucket = self.triples[total] = self.lengths[(3 * self.lengths >= total) & (self.lengths < total - 1)].tolist()
        while bucket:
            a = bucket[-1]
            if self.left[a] and self._pairs(total - a):
                break
            bucket.pop()
        for a in reversed(bucket):
            if self.free[a] > 0 and (two := self.pair(total - a, a)):
                return a, *two
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three free lengths that sum to the gap."""
        return (gap,) if self.free[gap] > 0 else self.pair(gap) or self.triple(gap)


def patterns(counts: Mapping[int, int], capacity: int = CAPACITY) -> Iterator[tuple[dict[int, int], int]]:
    """(lengths in a sequence with their counts, number of such sequences).

    Each pattern uses up at least one length to below its count in it, so the
    number of patterns is bounded by the capacity, not by the pieces.
    """
    index = SumIndex(counts, capacity)
    while len(index.lengths):
        chosen: Counter = Counter()
        gap = capacity
        while gap:
            # the longest comes first
            filling = index.exact(gap) if chosen else None
            if filling is None:
                best = index.longest(gap)
                if not best:
                    break
                filling = (best,)
            index.take(filling)
            chosen.update(filling)
            gap -= sum(filling)
        times = min(index.left[n] // c for n, c in chosen.items())
        index.use(chosen, times)
        yield dict(chosen), times


@dataclass(frozen=True)
class Plan:
    """For each length, where ranges of ranks start, what sequence and offset they start at, and how many a sequence holds."""

    segments: dict[int, np.ndarray]  # columns: first rank, first sequence, offset, pieces of this length a sequence
    sequences: int

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for n in np.unique(lengths).tolist():
            rows, mine = self.segments[n], lengths == n
            r = ranks[mine]
            first, base, at, each = rows[np.searchsorted(rows[:, 0], r, side="right") - 1].T
            sequence[mine] = base + (r - first) // each
            offset[mine] = at + (r - first) % each * n
        return sequence, offset


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> Plan:
    used: Counter = Counter()
    rows: dict[int, list] = {}
    sequences = 0
    for chosen, times in patterns(counts, capacity):
        offset = 0
        for n, c in chosen.items():
            rows.setdefault(n, []).append((used[n], sequences, offset, c))
            used[n] += c * times
            offset += n * c
        sequences += times
    return Plan({n: np.array(x, dtype=np.int64) for n, x in rows.items()}, sequences)


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, width = np.array([END_ID], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            coded = _tokens.encode_all(_text.texts(batch.column(1)), path)
            for doc_id, found in zip(batch.column(0).to_pylist(), coded, strict=True):
                ids = found.astype("<u4", copy=False).tobytes() + end
                for i, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=PIECES.names)

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    with_workers(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(tidy(_cut(path, capacity)), PIECES)


def _placed(how: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = how.place(lengths, ranks)
            names = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (with a long column length of 1 to capacity) with sequence_id and offset."""
    spark = cut.sparkSession
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    with scratch(spark):
        ranked = with_slots(cut, "length", "_rank")
        # one row for each length: at most `capacity`
        counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
        path = result(ranked.select(*cut.columns, "_rank").mapInArrow(tidy(_placed(plan(counts, capacity))), schema), "packed")
    return spark.read.schema(schema).parquet(path)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, path or _tokens.vocabulary_path(), capacity), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
