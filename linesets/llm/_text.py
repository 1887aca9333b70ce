"""Words of many texts at once, as numpy arrays over one buffer of bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20
BLANKS = b" \t\n\x0b\x0c\r"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACED = np.ones(256, dtype=bool)  # True: part of a word between blanks
SPACED[list(BLANKS)] = False

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


BASE = np.uint64(0xD6E8FEB86659FD93)
KEY = 0x2545F4914F6CDD1D  # of hashes that needn't be secret

#: Bytes of a lane, and of words that are hashed lane by lane; longer ones go through xxhash one by one.
LANE, SHORT = 8, 64
#: Bytes that are looked at together.
WINDOW_BYTES = 4 << 20
MASKS = np.array([(1 << 8 * n) - 1 for n in range(LANE + 1)], np.uint64)


def texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def slices(found: list[bytes | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) in runs of about `limit` bytes; null is empty."""
    at, part, size = 0, [], 0
    for i, t in enumerate(found):
        part.append(t or b"")
        size += len(part[-1])
        if size >= limit:
            yield at, part
            at, part, size = i + 1, [], 0
    if part:
        yield at, part


def stretches(found: list[bytes | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes], bool]]:
    """(first row, texts, ended) like slices, but a text beyond the limit is cut behind spaces and newlines.

    Its parts come one by one; ended is False for all but the last of them.
    """
    at, part, size = 0, [], 0
    for i, t in enumerate(found):
        t = t or b""
        if len(t) <= limit:
            part.append(t)
            size += len(t)
            if size < limit:
                continue
        if part:
            yield at, part, True
        at, part, size = i + 1, [], 0
        if len(t) <= limit:
            continue
        a = 0
        while len(t) - a > limit:
            b = max(t.rfind(b" ", a, a + limit), t.rfind(b"\n", a, a + limit))
            if b < 0:  # a word longer than that
                after = [x for x in (t.find(b" ", a + limit), t.find(b"\n", a + limit)) if x >= 0]
                if not after:
                    break
                b = min(after)
            yield i, [t[a : b + 1]], False
            a = b + 1
        yield i, [t[a:]], True
    if part:
        yield at, part, True


@dataclass
class Words:
    """hash of each word, in order; first[i] to first[i + 1] are those of text i.

    Word j is buffer[starts[j]:ends[j]]; the buffer goes on for a lane after its last word.
    """

    hash: np.ndarray
    first: np.ndarray
    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def spelled(self, which: np.ndarray) -> list[bytes]:
        return [self.buffer[a:b].tobytes() for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True)]


def lanes(buffer: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number."""
    return np.ndarray((max(len(buffer) - LANE + 1, 0),), "<u8", buffer, strides=(1,))


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = KEY) -> np.ndarray:
    """64-bit hashes of words of a buffer that goes on for a lane after them.

    A word's length and its lanes of 8 bytes pass one by one through a bijection on
    64 bits, so words of up to 8 bytes never collide and others do about as often as random
    numbers. Long words get xxh3. With a key that nobody knows beforehand no text can
    be made to collide.
    """
    at, length = lanes(buffer), ends - starts
    with np.errstate(over="ignore"):
        out = mix(length.astype(np.uint64) * STEP + np.uint64(key))
        out = mix((out ^ (at[starts] & MASKS[np.minimum(length, LANE)])) + STEP)
        more = np.flatnonzero((length > LANE) & (length <= SHORT))
        done = LANE
        while len(more):
            lane = at[starts[more] + done] & MASKS[np.minimum(length[more] - done, LANE)]
            out[more] = mix((out[more] ^ lane) + STEP)
            done += LANE
            more = more[length[more] > done]
    for i in np.flatnonzero(length > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buffer[starts[i] : ends[i]], key)
    return out


def same_words(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which words of two buffers (a lane longer than their last words) agree in all of `length` bytes."""
    left, right = lanes(a), lanes(b)
    out = ((left[a_starts] ^ right[b_starts]) & MASKS[np.minimum(length, LANE)]) == 0
    more, done = np.flatnonzero(out & (length > LANE) & (length <= SHORT)), LANE
    while len(more):
        differ = (left[a_starts[more] + done] ^ right[b_starts[more] + done]) & MASKS[np.minimum(length[more] - done, LANE)]
        out[more[differ != 0]] = False
        done += LANE
        more = more[(differ == 0) & (length[more] > done)]
    for i in np.flatnonzero(out & (length > SHORT)).tolist():
        out[i] = np.array_equal(a[a_starts[i] : a_starts[i] + length[i]], b[b_starts[i] : b_starts[i] + length[i]])
    return out


def _borders(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the last value is False."""
    edges = np.flatnonzero(held[1:] != held[:-1]) + 1
    if len(held) and held[0]:
        edges = np.concatenate([[0], edges])
    return edges[0::2], edges[1::2]


def words(part: list[bytes], inside: np.ndarray = SPACED, fold: np.ndarray | None = LOWER, key: int = KEY) -> Words:
    """Runs of bytes marked in `inside`, folded, with hashes of their bytes.

    Long buffers are worked on in windows that end between words.
    """
    joined = b" ".join([*part, b" " * LANE]) + b" "
    buffer = np.frombuffer(joined, dtype=np.uint8)
    if fold is not None:
        buffer = fold[buffer]
    ends_of_texts = np.cumsum(np.fromiter((len(t) + 1 for t in part), np.int64, len(part)))
    found: list[tuple[np.ndarray, ...]] = []
    a = 0
    while a < len(buffer):
        b = min(a + WINDOW_BYTES, len(buffer))
        while b < len(buffer) and inside[buffer[b - 1]]:  # to the end of the word
            stop = np.flatnonzero(~inside[buffer[b : b + WINDOW_BYTES]])
            b = b + int(stop[0]) + 1 if len(stop) else min(b + WINDOW_BYTES, len(buffer))
        starts, ends = _borders(inside[buffer[a:b]])
        starts, ends = starts + a, ends + a
        found.append((word_hashes(buffer, starts, ends, key) if len(starts) else np.empty(0, np.uint64), starts, ends))
        a = b
    hashes, starts, ends = (x[0] if len(x) == 1 else np.concatenate(x) for x in zip(*found, strict=True))
    first = np.concatenate([[0], np.searchsorted(starts, ends_of_texts)])
    return Words(hashes, first, buffer, starts, ends)


def chained(codes: list[np.ndarray]) -> np.ndarray:
    """One hash of each position's codes, in order."""
    with np.errstate(over="ignore"):
        out = mix(codes[0] + STEP)
        for c in codes[1:]:
            out = mix(out * BASE + c)
        return out
