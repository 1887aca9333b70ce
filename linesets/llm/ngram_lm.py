"""Interpolated modified Kneser-Ney bigram model over words, counted in Spark.

Tokens: words between ASCII blanks, A-Z lower-cased, then one end for each text;
the first word's context is a start mark that is never predicted. With c(h w) the
count of w after h, c(h) their sum, and N1(. w) the number of distinct contexts
of w:

    p(w | h) = max(c(h w) - D(c(h w)), 0) / c(h) + g(h) p(w)
    p(w)     = max(N1(. w) - D'(N1(. w)), 0) / N1(. .) + g' / (V + 1)

D has three values (counts 1, 2, and 3 or more) from the counts of counts, for
each level of its own; g(h) and g' are what the discounts leave. V is the number
of distinct training tokens; V + 1 makes room for the unknown word, so
probabilities over the vocabulary and the unknown word sum to 1. A context
not seen in training leaves p(w).

Counting: tasks turn texts into arrays of 64-bit word hashes, sum equal n-grams
of about `FLUSH` tokens, and send each slot one row of packed arrays. A slot is a range of
context hashes, small enough for a worker; a bucket is a run of slots and is one file of each
kind. Contexts with more than about a quarter of a slot are split into parts by the next word,
each a context of its own to the slots. The numbers of slots and buckets grow with the tokens.
A bucket is written slot by slot: sorted context hashes with their sums and where their words end,
then each one's sorted next words and counts. Workers map the arrays into memory, so only
pages that a search touches are read; where the shared folder isn't a mounted one, an array is
fetched once and mapped from there.

Words are told apart by 64 bits under a key drawn for each model, so texts can't be made to
collide; of V distinct words two share a hash with a chance of V^2 / 2^65.

Order 2 is what the disk budget allows: see README. Null texts are empty: one end
token. Rows repeat as often as they stand in the table; their order makes no difference.
A null doc_id trains. Very long texts are worked on in parts. An empty table gives no rows.
Only the three columns asked for are read, so others may have any name.
"""

from __future__ import annotations

import math
import os
import secrets
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesets.llm import _text
from linesets.llm._common import folder, materialize, result, scratch, table, tidy, with_workers, worker_cache

FLUSH = 1_200_000
#: Training tokens of a slot and of a bucket, about; from `WIDE` buckets on both their number and their size grow.
SLOT_TOKENS = 250_000
BUCKET_TOKENS = 1_500_000
WIDE = 4096
#: A context is split if it has more of the tokens than a quarter of a slot, or than this share of all of them.
HOT_SHARE = 1 << 20
START, END = np.uint64(0x5DEECE66D1234567), np.uint64(0xA0761D6478BD642F)
FOLDS, HELD_OUT = 7, 2
SCORED_BYTES = 2 << 20


# arrays in the shared folder ---------------------------------------------------------------


def _local(path: str) -> str | None:
    """The path as files are opened by, if the shared folder is a mounted one."""
    return "/" + path[len("file:") :].lstrip("/") if path.startswith("file:") else None


def _store(path: str):
    """(file system, path in it) of a shared folder that isn't a mounted one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Writer:
    """An array in the shared folder, written part by part; whole or not there, so a repeated task does no harm."""

    def __init__(self, path: str):
        self.path, self.local, self.staged, self.size = path, _local(path), f"{path}.{uuid.uuid4().hex}", 0
        if self.local is None:
            self.store, self.inner = _store(self.staged)
            self.out = self.store.open_output_stream(self.inner)
        else:
            os.makedirs(os.path.dirname(self.local), exist_ok=True)
            self.out = open(_local(self.staged), "wb")  # noqa: SIM115

    def add(self, array: np.ndarray) -> None:
        self.out.write(np.ascontiguousarray(array).data.cast("B") if array.size else b"")
        self.size += array.size

    def close(self) -> None:
        self.out.close()
        if self.local is None:
            self.store.move(self.inner, self.inner[: -len(self.staged) + len(self.path)])
        else:
            os.replace(_local(self.staged), self.local)


def save(path: str, array: np.ndarray) -> None:
    out = Writer(path)
    out.add(array)
    out.close()


def load(path: str, dtype) -> np.ndarray:
    """The array, mapped into memory; empty if it was never written."""
    local = _local(path)
    if local is not None:
        return np.memmap(local, dtype, "r") if os.path.exists(local) and os.path.getsize(local) else np.empty(0, dtype)
    from pyarrow import fs

    store, inner = _store(path)
    info = store.get_file_info(inner)
    if info.type != fs.FileType.File or not info.size:
        return np.empty(0, dtype)
    held = tempfile.TemporaryFile()  # noqa: SIM115  gone with the array
    with store.open_input_stream(inner) as f:
        shutil.copyfileobj(f, held, 1 << 20)
    held.flush()
    return np.memmap(held, dtype, "r")


# tokens, slots and buckets -----------------------------------------------------------------


@dataclass
class Tokens:
    """hash of each token; first[i] to first[i + 1] are those of text i; before: what stands before the first of them."""

    hash: np.ndarray
    first: np.ndarray
    before: np.uint64

    def starts(self) -> np.ndarray:
        """Tokens that begin a text."""
        return self.first[1 if self.before != START else 0 : -1]


def tokens(part: list[bytes], key: int, ended: bool = True, before: np.uint64 = START) -> Tokens:
    """ended: whether the last text's end is there. before: the last token of a text that goes on."""
    found = _text.words(part, key=key)
    n = np.diff(found.first)
    if not ended:
        return Tokens(found.hash, found.first, before)
    first = np.concatenate([[0], np.cumsum(n + 1)])
    hashes = np.full(int(first[-1]), END, np.uint64)
    is_word = np.ones(len(hashes), bool)
    is_word[first[1:] - 1] = False
    hashes[is_word] = found.hash
    return Tokens(hashes, first, before)


def all_tokens(found: list[bytes | None], key: int, limit: int = _text.SLICE_BYTES) -> Iterator[tuple[int, Tokens, bool]]:
    """(first row, tokens, ended) of texts; a long text comes in parts."""
    before = START
    for row, part, ended in _text.stretches(found, limit):
        t = tokens(part, key, ended, before)
        if len(t.hash):
            yield row, t, ended
        if ended:
            before = START
        elif len(t.hash):
            before = t.hash[-1]


def slot_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Ranges of hashes, by their top 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """key of the words' hashes; how many buckets and how many slots in each; hot contexts (sorted) and their parts."""

    key: int
    buckets: int
    slots: int
    hot: bytes = b""
    parts: bytes = b""

    @staticmethod
    def of(size: int, key: int) -> Layout:
        units = size // 6 / BUCKET_TOKENS  # a word and its blank take about 6 bytes
        buckets = max(8, math.ceil(units if units <= WIDE else math.sqrt(WIDE * units)))
        return Layout(key, buckets, max(1, math.ceil(units * BUCKET_TOKENS / SLOT_TOKENS / buckets)))

    def contexts(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The context each pair is stored under: parts of hot ones go by the word's top bits."""
        hot, parts = np.frombuffer(self.hot, np.uint64), np.frombuffer(self.parts, np.uint64)
        if not len(hot):
            return contexts
        at = np.searchsorted(hot, contexts)
        at[at == len(hot)] = 0
        split = np.flatnonzero(hot[at] == contexts)
        if not len(split):
            return contexts
        out = contexts.copy()
        part = (words[split] >> np.uint64(32)) * parts[at[split]] >> np.uint64(32)
        out[split] = _text.chained([contexts[split], part])
        return out


def _rows(buckets: np.ndarray, arrays: dict[str, np.ndarray], kind: str = "") -> pa.RecordBatch:
    """One row for each bucket, the arrays' parts as bytes; inside a bucket the order stays."""
    order = np.argsort(buckets, kind="stable")
    edges = np.flatnonzero(np.diff(buckets[order], prepend=-1)) if len(buckets) else np.empty(0, np.int64)
    ends = [*edges[1:].tolist(), len(buckets)][: len(edges)]
    sorted_arrays = [a[order] for a in arrays.values()]
    blobs = [pa.array([a[s:e].tobytes() for s, e in zip(edges.tolist(), ends, strict=True)], pa.binary()) for a in sorted_arrays]
    where = pa.array(buckets[order][edges], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(where), pa.string()), where, *blobs], names=["kind", "bucket", *arrays])


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str], dtypes: list) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """(key, arrays of a row) from rows sorted by their key."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        found = zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys), strict=True)
        for i, key in enumerate(found):
            # a copy, so that a batch isn't held by one of its rows
            yield key, [np.frombuffer(c[i].as_py(), d) for c, d in zip(columns, dtypes, strict=True)]


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys, and the sums of values at each."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[edges], *(np.add.reduceat(v[order], edges) for v in values)]


class Sums:
    """Sums of counts by word, merged as they come: held entries are at most about twice the distinct words, or FLUSH."""

    def __init__(self) -> None:
        self.held: list[list[np.ndarray]] = []
        self.size = self.least = 0

    def add(self, words: np.ndarray, counts: np.ndarray) -> None:
        self.held.append([words, counts])
        self.size += len(words)
        if self.size > max(FLUSH, 2 * self.least):
            self.merged()
            self.least = self.size

    def merged(self) -> list[np.ndarray]:
        found = _sum_by(*map(np.concatenate, zip(*self.held, strict=True))) if self.held else [np.empty(0, np.uint64), np.empty(0, np.int64)]
        self.held, self.size = [found], len(found[0])
        return found


def _dealt(rows: DataFrame, n: int, *then: str) -> DataFrame:
    # a bucket is a partition, so none holds several by chance
    return rows.repartitionById(n, "bucket").sortWithinPartitions("bucket", *then)


# counting ----------------------------------------------------------------------------------


def _count_words(how: Layout):
    """(bucket, word, count) rows of a task's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            for _, t, _ in all_tokens(_text.texts(batch.column(0)), how.key):
                sums.add(*np.unique(t.hash, return_counts=True))
                if sums.least > FLUSH // 2:
                    words, counts = sums.merged()
                    yield _rows(slot_of(words, how.buckets), {"word": words, "count": counts})
                    sums = Sums()
        words, counts = sums.merged()
        yield _rows(slot_of(words, how.buckets), {"word": words, "count": counts})

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(bucket, words, counts) summed up, from rows sorted by bucket."""
    key, sums = None, Sums()
    for (bucket,), arrays in _grouped(batches, ["bucket"], names, [np.uint64, np.int64]):
        if bucket != key and key is not None:
            yield key, sums.merged()
            sums = Sums()
        key = bucket
        sums.add(*arrays)
    if key is not None:
        yield key, sums.merged()


def _write_words(folder: str, hot_from: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (words, counts) in _by_bucket(batches, ["word", "count"]):
            save(f"{folder}/word-{bucket}", words)
            save(f"{folder}/count-{bucket}", counts)
            hot = counts > hot_from
            facts = [pa.array([x], pa.int64()) for x in (bucket, len(words), int(counts.sum()))]
            shown = [pa.array([x.tobytes()], pa.binary()) for x in (words[hot], counts[hot])]
            yield pa.RecordBatch.from_arrays([*facts, *shown], names=["bucket", "n", "total", "hot", "hot_count"])

    return run


def _count_bigrams(how: Layout):
    """(bucket, slot, context, run, word, count) rows: contexts once, with how many words follow each."""

    def flush(held: list[Tokens]) -> pa.RecordBatch:
        # hashes become places in the sorted distinct words, so a pair sorts as one number, by context first
        # (after the start mark, which no token is)
        sizes = np.array([len(t.hash) for t in held])
        heads = np.cumsum(sizes) - sizes
        open_ = [i for i, t in enumerate(held) if t.before != START]
        distinct, place = np.unique(np.concatenate([*(t.hash for t in held), np.array([held[i].before for i in open_], np.uint64)]), return_inverse=True)
        place = place.astype(np.uint64) + np.uint64(1)
        place, before = place[: int(sizes.sum())], place[int(sizes.sum()) :]
        context = np.empty_like(place)
        context[1:] = place[:-1]
        context[np.concatenate([t.starts() + h for t, h in zip(held, heads, strict=True)])] = 0
        context[heads[open_]] = before
        pairs = np.sort(context << np.uint64(32) | place)
        edges = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        counts = np.diff(np.concatenate([edges, [len(pairs)]])).astype(np.uint32)
        pairs = pairs[edges]
        names = np.concatenate([[START], distinct])
        contexts, words = names[(pairs >> np.uint64(32)).astype(np.int64)], names[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        contexts = how.contexts(contexts, words)
        slots = slot_of(contexts, how.buckets * how.slots)
        order = np.argsort(slots, kind="stable")
        slots, contexts, words, counts = slots[order], contexts[order], words[order], counts[order]
        heads = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))
        runs = np.diff(np.concatenate([heads, [len(words)]])).astype(np.uint32)
        a, b = _rows(slots[heads], {"context": contexts[heads], "run": runs}), _rows(slots, {"word": words, "count": counts})
        slot = a.column("bucket").to_numpy()
        where = [pa.array(slot // how.slots, pa.int32()), pa.array(slot % how.slots, pa.int32())]
        return pa.RecordBatch.from_arrays([*where, a.column("context"), a.column("run"), b.column("word"), b.column("count")], names=["bucket", "slot", "context", "run", "word", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, t, _ in all_tokens(_text.texts(batch.column(0)), how.key):
                held.append(t)
                size += len(t.hash)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


LEVELS = 3  # discounts: counts 1, 2, 3 and more


def _by_count(counts: np.ndarray) -> list[np.ndarray]:
    return [(counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts >= LEVELS).astype(np.int64)]


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].tolist()


class Bucket:
    """Writes a bucket's contexts and their words, slot by slot."""

    def __init__(self, folder: str, bucket: int):
        self.outs = {k: Writer(f"{folder}/{k}-{bucket}") for k in ("context", "stats", "next", "next-count", "next-many")}
        self.counts = np.zeros(4, np.int64)

    def add(self, runs: list[list[np.ndarray]]) -> np.ndarray:
        """One slot's (contexts, run lengths, words, counts) rows; gives the words of its pairs."""
        contexts = np.concatenate([np.repeat(c, n) for c, n, _, _ in runs])
        words, counts = np.concatenate([r[2] for r in runs]), np.concatenate([r[3] for r in runs])
        order = np.lexsort((words, contexts))
        contexts, words, counts = contexts[order], words[order], counts[order].astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], (contexts[1:] != contexts[:-1]) | (words[1:] != words[:-1])]))
        contexts, words, counts = contexts[edges], words[edges], np.add.reduceat(counts, edges)
        heads = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))
        ends = self.outs["next"].size + np.concatenate([heads[1:], [len(words)]])
        sums = [np.add.reduceat(x, heads) for x in (counts, *_by_count(counts))]
        self.outs["context"].add(contexts[heads])
        self.outs["stats"].add(np.column_stack([*sums, ends]))
        # counts in 32 bits, with those beyond them apart
        many = np.flatnonzero(counts >= MANY)
        self.outs["next-many"].add(np.column_stack([self.outs["next"].size + many, counts[many]]))
        self.outs["next"].add(words)
        self.outs["next-count"].add(np.minimum(counts, MANY).astype(np.uint32))
        self.counts += _counts_of_counts(counts)
        return words

    def close(self) -> None:
        for out in self.outs.values():
            out.close()


MANY = 0xFFFFFFFF
STATS = "kind string, bucket int, word binary, count binary"


def _write_bigrams(folder: str, how: Layout):
    """Writes buckets; rows for the words that follow a context (how many contexts they follow), by bucket, and for counts of counts."""

    def followed(sums: Sums) -> pa.RecordBatch:
        words, counts = sums.merged()
        return _rows(slot_of(words, how.buckets), {"word": words, "count": counts}, "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out, sums = None, [], None, Sums()
        total = np.zeros(4, np.int64)
        for (bucket, slot), arrays in _grouped(batches, ["bucket", "slot"], ["context", "run", "word", "count"], [np.uint64, np.uint32, np.uint64, np.uint32]):
            if (bucket, slot) != key and held:
                words = out.add(held)
                held = []
                sums.add(*np.unique(words, return_counts=True))
                if sums.least > FLUSH // 2:
                    yield followed(sums)
                    sums = Sums()
            if key is None or bucket != key[0]:
                if out is not None:
                    out.close()
                    total += out.counts
                out = Bucket(folder, bucket)
            key = bucket, slot
            held.append(arrays)
        if held:
            sums.add(*np.unique(out.add(held), return_counts=True))
            out.close()
            total += out.counts
        yield followed(sums)
        yield _rows(np.zeros(4, np.int64), {"word": np.arange(4), "count": total}, "counts")

    return run


def _write_followed(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (words, counts) in _by_bucket(batches, ["word", "count"]):
            save(f"{folder}/after-{bucket}", words)
            save(f"{folder}/after-count-{bucket}", counts)
            facts = [bucket, int(counts.sum()), *_counts_of_counts(counts), int((counts >= LEVELS).sum())]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in facts], names=["bucket", "total", "c1", "c2", "c3", "c4", "more"])

    return run


# the model ---------------------------------------------------------------------------------


def discounts(c: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3 and more, from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = map(float, c)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    d = [0.0]
    for k, (low, high) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        # without such counts: the plain discount
        d.append(min(max(k - (k + 1) * y * high / low, 0.0), float(k)) if low else min(y, float(k)))
    return np.array(d)


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that hold for all of them."""

    folder: str
    layout: Layout
    train_tokens: int
    vocabulary: int
    continuations: int
    high: tuple[float, ...]
    low: tuple[float, ...]
    low_left: float


class Reader:
    """Looks hashes up in the arrays of a model."""

    def __init__(self, model: Model):
        self.model, self.arrays = model, {}
        how = model.layout
        self.hot, parts = np.frombuffer(how.hot, np.uint64), np.frombuffer(how.parts, np.uint64).astype(np.int64)
        # sums of hot contexts over their parts
        of = np.repeat(np.arange(len(parts)), parts)
        part = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)).astype(np.uint64)
        found = self._stats(_text.chained([self.hot[of], part]))[:, :4] if len(of) else np.zeros((0, 4), np.int64)
        self.hot_stats = np.zeros((len(parts), 4), np.int64)
        np.add.at(self.hot_stats, of, found)

    def array(self, name: str, dtype, width: int = 0) -> np.ndarray:
        if name not in self.arrays:
            found = load(f"{self.model.folder}/{name}", dtype)
            self.arrays[name] = found.reshape(-1, width) if width else found
        return self.arrays[name]

    def _by_bucket(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        buckets = slot_of(keys, self.model.layout.buckets)
        order = np.lexsort((keys, buckets))
        edges = np.flatnonzero(np.diff(buckets[order], prepend=-1))
        for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)], strict=True):
            yield int(buckets[order[s]]), order[s:e]

    def find(self, keys: np.ndarray, kind: str) -> np.ndarray:
        """Counts of words, 0 where there are none."""
        out = np.zeros(len(keys), np.int64)
        for b, rows in self._by_bucket(keys):
            at, hit = _places(self.array(f"{kind[0]}-{b}", np.uint64), keys[rows])
            out[rows[hit]] = self.array(f"{kind[1]}-{b}", np.int64)[at[hit]]
        return out

    def _stats(self, contexts: np.ndarray) -> np.ndarray:
        """Sums of stored contexts and where their words end, 0 where there are none."""
        out = np.zeros((len(contexts), 5), np.int64)
        for b, rows in self._by_bucket(contexts):
            at, hit = _places(self.array(f"context-{b}", np.uint64), contexts[rows])
            out[rows[hit]] = self.array(f"stats-{b}", np.int64, 5)[at[hit]]
        return out

    def stats(self, contexts: np.ndarray) -> np.ndarray:
        """(tokens, words that follow once, twice, more often) of contexts."""
        out = self._stats(contexts)[:, :4]
        at, hot = _places(self.hot, contexts)
        out[hot] = self.hot_stats[at[hot]]
        return out

    def pairs(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Counts of words after contexts."""
        stored = self.model.layout.contexts(contexts, words)
        out = np.zeros(len(words), np.int64)
        for b, rows in self._by_bucket(stored):
            known, stats = self.array(f"context-{b}", np.uint64), self.array(f"stats-{b}", np.int64, 5)
            at, hit = _places(known, stored[rows])
            rows, at = rows[hit], at[hit]
            if not len(rows):
                continue
            low, high = np.where(at > 0, stats[np.maximum(at, 1) - 1, 4], 0), stats[at, 4]
            following, asked, ends = self.array(f"next-{b}", np.uint64), words[rows], stats[at, 4]
            while (low < high).any():  # the first word that isn't smaller, for all pairs at once
                middle = (low + high) >> 1
                less = (low < high) & (following[np.minimum(middle, len(following) - 1)] < asked)
                low, high = np.where(less, middle + 1, low), np.where(less, high, np.where(low < high, middle, high))
            there = np.flatnonzero(low < ends)
            there = there[following[low[there]] == asked[there]]
            out[rows[there]] = self.array(f"next-count-{b}", np.uint32)[low[there]]
            many = np.flatnonzero(out[rows[there]] == MANY)
            if len(many):
                beyond = self.array(f"next-many-{b}", np.int64, 2)
                out[rows[there[many]]] = beyond[np.searchsorted(beyond[:, 0], low[there[many]]), 1]
        return out

    def score(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, base score, score) of each text."""
        m = self.model
        words, word_of = np.unique(t.hash, return_inverse=True)
        count, followed = self.find(words, ("word", "count")), self.find(words, ("after", "after-count"))
        base = np.log10((count + 1) / (m.train_tokens + m.vocabulary + 1))
        low_d = np.array(m.low)
        low = np.maximum(followed - low_d[np.minimum(followed, 3)], 0) / max(m.continuations, 1) + m.low_left / (m.vocabulary + 1)
        # contexts are words, the start, or what a long text's part before ended with
        contexts = np.concatenate([words, [START, t.before]])
        stats = self.stats(contexts)
        before = np.empty_like(word_of)
        before[1:] = word_of[:-1]
        before[0] = len(words) + 1
        before[t.starts()] = len(words)
        pairs, pair_of = np.unique(before.astype(np.int64) * len(words) + word_of, return_inverse=True)
        c, w = np.divmod(pairs, len(words))
        seen = self.pairs(contexts[c], words[w])
        high = np.array(m.high)
        total = stats[c, 0]
        left = stats[c, 1:] @ high[1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(total > 0, (np.maximum(seen - high[np.minimum(seen, 3)], 0) + left * low[w]) / total, low[w])
        per_token = np.log10(p)[pair_of]
        begin = t.first[:-1]  # every text has a token: its end, or some words of a part
        sums = [np.add.reduceat(x, begin) for x in ((count > 0)[word_of].astype(np.int64), base[word_of], per_token)]
        return np.diff(t.first), *sums


def _places(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each key in a sorted array, whether it is there)."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return at, known[at] == keys


def fit(docs: DataFrame, text: str = "text", key: int | None = None) -> Model:
    """Counts a corpus into sorted arrays in the shared folder. key: of the words' hashes; drawn if not given."""
    spark = docs.sparkSession
    with_workers(spark)
    slim = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    where = folder(spark, "lm")
    size = slim.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    how = Layout.of(size, secrets.randbits(64) if key is None else key)
    n = how.buckets
    hot_from = max(SLOT_TOKENS // 4, size // 6 // HOT_SHARE)
    with scratch(spark):
        rows = slim.mapInArrow(tidy(_count_words(how)), "kind string, bucket int, word binary, count binary")
        out = "bucket bigint, n bigint, total bigint, hot binary, hot_count binary"
        written = materialize(_dealt(rows, n).mapInArrow(tidy(_write_words(where, hot_from)), out), "lm-words")
        facts = written.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
        # fewer than HOT_SHARE, as each has more than that share of all tokens
        hot = written.filter(F.octet_length("hot") > 0).select("hot", "hot_count").collect()
        words, counts = (np.frombuffer(b"".join(bytes(r[c]) for r in hot), d) for c, d in (("hot", np.uint64), ("hot_count", np.int64)))
        # as many texts begin as end
        words, counts = np.append(words, START), np.append(counts, counts[words == END].max(initial=0))
        words, counts = words[counts > hot_from], counts[counts > hot_from]
        order = np.argsort(words)
        how = replace(how, hot=words[order].tobytes(), parts=(-(-counts[order] // hot_from)).astype(np.uint64).tobytes())
        pairs = slim.mapInArrow(tidy(_count_bigrams(how)), "bucket int, slot int, context binary, run binary, word binary, count binary")
        stats = materialize(_dealt(pairs, n, "slot").mapInArrow(tidy(_write_bigrams(where, how)), STATS), "lm-bigrams")
        high = np.zeros(4, np.int64)
        for r in stats.filter("kind = 'counts'").select("count").collect():  # one row a task
            high += np.frombuffer(bytes(r["count"]), np.int64)
        out = "bucket bigint, total bigint, c1 bigint, c2 bigint, c3 bigint, c4 bigint, more bigint"
        sums = [F.sum(c).alias(c) for c in ("total", "c1", "c2", "c3", "c4", "more")]
        low = _dealt(stats.filter("kind = 'word'"), n).mapInArrow(tidy(_write_followed(where)), out).agg(*sums).first()
    low_d = discounts([low[c] or 0 for c in ("c1", "c2", "c3", "c4")])
    total = low["total"] or 0
    left = (low_d[1] * (low["c1"] or 0) + low_d[2] * (low["c2"] or 0) + low_d[3] * (low["more"] or 0)) / total if total else 1.0
    return Model(where, how, facts["total"] or 0, facts["n"] or 0, total, tuple(discounts(high.tolist())), tuple(low_d), left)


_readers: dict[str, Reader] = worker_cache(__name__)


def reader(model: Model) -> Reader:
    if model.folder not in _readers:
        _readers.clear()
        _readers[model.folder] = Reader(model)
    return _readers[model.folder]


SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = reader(model)
        for batch in batches:
            sums = [np.zeros(len(batch), d) for d in (np.int64, np.int64, np.float64, np.float64)]
            for row, t, _ in all_tokens(_text.texts(batch.column(2)), model.layout.key, SCORED_BYTES):
                for out, found in zip(sums, known.score(t), strict=True):
                    out[row : row + len(found)] += found
            trained = pa.array(np.full(len(batch), model.train_tokens, np.int64))
            size, hits, base, score = map(pa.array, sums)
            columns = [batch.column(0), batch.column(1), size, hits, trained, base, score]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def perplexity(score, n_tokens):
    """Column: perplexity from a log10 probability."""
    return F.pow(F.lit(10.0), -score / n_tokens)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all documents by a model of those outside the held-out fold."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(0)) == HELD_OUT
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    spark = docs.sparkSession
    with scratch(spark):
        model = fit(slim.filter(~F.col("held_out")))
        # a row of seven numbers for each document; the model goes when they are written
        scored = slim.mapInArrow(tidy(_scores(model)), SCHEMA)
        path = result(scored, "lm-scores")
    return spark.read.schema(SCHEMA).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


#: CRC-32 of a column's decimal digits.
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, case when a & 1 = 1 then 3988292384 else 0 end))), 4294967295)"""
#: The columns that no logarithm enters.
COUNT_SQL = rf"""
with d as (
    select doc_id, {_CRC} % {FOLDS} = {HELD_OUT} as held_out,
        list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') as t
    from documents),
w as (select doc_id, held_out, unnest(t) as token from d),
k as (select distinct token from w where not held_out)
select w.doc_id, held_out, count(*) as n_tokens, count(k.token) as n_known, (select count(*) from w where not held_out) as train_tokens
from w left join k on w.token = k.token group by w.doc_id, held_out
"""
