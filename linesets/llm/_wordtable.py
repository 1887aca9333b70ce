"""Bounded per-worker table from words to token ids, as sorted arrays, for many words at once.

A word costs its hash, a sort and a gather; only a word that the table doesn't
hold yet costs more. A word found by its hash is compared byte by byte with the one the
table holds, so words whose hashes collide never share their values.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from linesets.llm import _text

#: Entries and bytes of words and values that a table holds before it starts anew.
ENTRIES = 1_000_000
POOL_BYTES = 48_000_000

#: Pieces between spaces and newlines.
BETWEEN = np.ones(256, dtype=bool)
BETWEEN[list(b" \n")] = False


class Pool:
    """Arrays of one type one after another; row i is values[bounds[i]:bounds[i + 1]]."""

    def __init__(self, dtype, spare: int = 0):
        self.values, self.bounds, self.rows, self.spare = np.zeros(1 << 16, dtype), np.zeros(1 << 12, np.int64), 0, spare

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        end, rows = int(self.bounds[self.rows]), self.rows + len(sizes)
        if end + len(values) + self.spare > len(self.values):
            self.values = np.concatenate([self.values[:end], np.zeros(max(end // 2, len(values)) + len(values) + self.spare, self.values.dtype)])
        if rows + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds[: self.rows + 1], np.zeros(max(self.rows // 2, len(sizes)) + len(sizes), np.int64)])
        self.values[end : end + len(values)] = values
        self.bounds[self.rows + 1 : rows + 1] = end + np.cumsum(sizes)
        self.rows = rows

    def bytes(self) -> int:
        return int(self.bounds[self.rows]) * self.values.itemsize


class WordTable:
    """compute gives, for a list of words, (ids of all of them in order, how many each has)."""

    def __init__(self, compute: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype, entries: int = ENTRIES):
        self.compute, self.dtype, self.entries = compute, dtype, entries
        self._clear()

    def _clear(self) -> None:
        # sorted keys and where their values are; new ones wait in a smaller table
        self.old = self.new = (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.words, self.ids = Pool(np.uint8, _text.LANE), Pool(self.dtype)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of sorted keys, -1 where there are none."""
        out = np.full(len(keys), -1)
        for known, row in (self.old, self.new):
            at = np.searchsorted(known, keys)
            inside = np.flatnonzero(at < len(known))
            hit = inside[known[at[inside]] == keys[inside]]
            out[hit] = row[at[hit]]
        return out

    def _add(self, spelled: list[bytes]) -> np.ndarray:
        rows = np.arange(self.words.rows, self.words.rows + len(spelled))
        self.ids.add(*self.compute(spelled))
        self.words.add(np.frombuffer(b"".join(spelled), np.uint8), np.fromiter(map(len, spelled), np.int64, len(spelled)))
        return rows

    def rows(self, found: _text.Words) -> np.ndarray:
        """Row of each word; rows stay valid until the next call."""
        if self.words.rows > self.entries or self.words.bytes() + self.ids.bytes() > POOL_BYTES:
            self._clear()
        keys, sample, inverse = np.unique(found.hash, return_index=True, return_inverse=True)
        row = self._find(keys)
        missing = np.flatnonzero(row < 0)
        if len(missing):
            row[missing] = self._add(found.spelled(sample[missing]))
            both = [np.concatenate(x) for x in zip(self.new, (keys[missing], row[missing]), strict=True)]
            order = np.argsort(both[0], kind="stable")
            self.new = both[0][order], both[1][order]
            if len(order) > 50_000 + len(self.old[0]) // 4:
                both = [np.concatenate(x) for x in zip(self.old, self.new, strict=True)]
                order = np.argsort(both[0], kind="stable")
                self.old, self.new = (both[0][order], both[1][order]), (np.empty(0, np.uint64), np.empty(0, np.int64))
        out = row[inverse]
        length, begin = found.ends - found.starts, self.words.bounds[out]
        same = length == self.words.bounds[out + 1] - begin
        same[same] = _text.same_words(found.buffer, found.starts[same], self.words.values, begin[same], length[same])
        if not same.all():  # another word with the same hash
            apart = np.flatnonzero(~same)
            spelled = found.spelled(apart)
            distinct = list(dict.fromkeys(spelled))
            place = dict(zip(distinct, self._add(distinct).tolist(), strict=True))
            out[apart] = [place[w] for w in spelled]
        return out

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self.ids.bounds[rows + 1] - self.ids.bounds[rows]

    def gather(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows in order, and where those of text i begin."""
        sizes = self.sizes(rows)
        return spread(self.ids.values, self.ids.bounds[rows], sizes), np.concatenate([[0], np.cumsum(sizes)])[first]


def spread(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parts of an array one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 30 else np.int64
    return values[np.repeat((begin - (ends - sizes)).astype(kind), sizes) + np.arange(total, dtype=kind)]
