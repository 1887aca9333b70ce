"""BPE encoding by per-prefix dynamic programming, and decoding.

The encoding of every prefix of a word ends in exactly one token. That token is
found among the vocabulary's tokens that end there, the longest first: it is the
one that is compatible with the last token of the prefix before it. Storing the
last token of each prefix gives the encoding by following back-pointers, in
time linear in the word for tokens of bounded length, without merging.

* Tokens that end at a position come from a suffix automaton over all token
  strings: its state is the longest suffix that occurs in any token, and a chain
  of links visits the suffixes that are tokens themselves.
* Two tokens are compatible if merging their concatenation leaves them apart.
  A merge across their border could only join a token x on the right edge of
  the first (at some stage of its own merges) with a token y on the left edge of
  the second. It happens if it comes before x is merged into its parent, and not
  after y is; at equal rank the pair farther left goes first.

Many words go on together: one step of the automaton, one look at the suffixes and one
of the back-pointers is a handful of array operations for all of them.

A word's last symbol carries the end-of-word mark, as a symbol of its own.
Normalisation and the split into words are those of the tokenizer file. The
vocabulary's path is a parameter.

Null and empty texts have no ids; an empty table gives no rows. Rows are handled one by one, so repeated
rows and other columns make no difference, and there are no ties: a prefix has one last token. Very long texts are
coded in parts that end behind blanks, and very long words take linear time.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesets.llm import _text, _tokens
from linesets.llm._common import table, tidy, with_workers, worker_cache
from linesets.llm._tokens import vocabulary_path
from linesets.llm._wordtable import BETWEEN, Pool, WordTable, spread

NEVER = 1 << 60
MARKED = 1 << 21  # added to a character's code where it ends a word
STATE = 22  # bits of a symbol
#: Entries of the table of last tokens, pieces that are split together, and pairs of tokens remembered as compatible or not.
TABLE, MANY, MOST_PAIRS = 1 << 21, 16384, 1 << 20


def symbols(word: str, ended: bool) -> list[int]:
    codes = list(map(ord, word))
    if ended:
        codes[-1] += MARKED
    return codes


class SuffixAutomaton:
    """Of many strings of symbols; ends(state) lists tokens that are suffixes of what was read."""

    def __init__(self, strings: dict[int, list[int]]):
        self.step: dict[int, int] = {}
        self.length, self.link = [0], [-1]
        follow: list[list[int]] = [[]]
        token = {}
        for t, codes in strings.items():
            state = 0
            for code in codes:
                state = self._extend(state, code, follow)
            token[state] = t
        # the nearest state on the way to the root, itself included, that is a whole token
        self.token, self.next = [token.get(s, -1) for s in range(len(self.length))], [0] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            up = self.link[s]
            self.next[s] = up if self.token[up] >= 0 else self.next[up]

    def _new(self, length: int, link: int, follow: list[list[int]]) -> int:
        self.length.append(length)
        self.link.append(link)
        follow.append([])
        return len(self.length) - 1

    def _clone(self, low: int, state: int, code: int, follow: list[list[int]]) -> int:
        """A copy of state for the strings of low and its suffixes followed by code."""
        copy = self._new(self.length[low] + 1, self.link[state], follow)
        for c in follow[state]:
            self.step[copy << STATE | c] = self.step[state << STATE | c]
        follow[copy] = list(follow[state])
        self.link[state] = copy
        while low >= 0 and self.step.get(low << STATE | code) == state:
            self.step[low << STATE | code] = copy
            low = self.link[low]
        return copy

    def _extend(self, last: int, code: int, follow: list[list[int]]) -> int:
        known = self.step.get(last << STATE | code)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, known, code, follow)
        new = self._new(self.length[last] + 1, 0, follow)
        low = last
        while low >= 0 and low << STATE | code not in self.step:
            self.step[low << STATE | code] = new
            follow[low].append(code)
            low = self.link[low]
        if low >= 0:
            known = self.step[low << STATE | code]
            self.link[new] = known if self.length[known] == self.length[low] + 1 else self._clone(low, known, code, follow)
        return new


class Numbers:
    """From 64-bit keys to numbers of 0 and more, for many keys at once: open addressing in two arrays."""

    FREE = np.uint64(0xFFFFFFFFFFFFFFFF)  # no key is this

    def __init__(self) -> None:
        self._room(1 << 12)

    def _room(self, size: int) -> None:
        self.keys, self.values, self.held = np.full(size, self.FREE), np.full(size, -1, np.int64), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (_text.mix(keys) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys: distinct and new."""
        if 2 * (self.held + len(keys)) > len(self.keys):
            used = self.keys != self.FREE
            keys, values = np.concatenate([self.keys[used], keys]), np.concatenate([self.values[used], values])
            self._room(1 << (3 * len(keys)).bit_length())
        self.held += len(keys)
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == self.FREE
            self.keys[at[left[free]]] = keys[left[free]]  # of several keys one stays
            won = free & (self.keys[at[left]] == keys[left])
            self.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 where there are none."""
        at, out = self._slots(keys), np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there != self.FREE)]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        return out


class Bpe:
    """Encoder over the vocabulary and merges of a tokenizers file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("only a BPE model with all base symbols and no prefix is supported")
        if model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("ignore_merges and dropout change what merging means")
        if spec.get("decoder"):
            raise ValueError("only files without a decoder are supported: tokens with blanks between")
        tokenizer = Tokenizer.from_file(path)
        self.normalize, self.split = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.end, self.ascii_split = model.get("end_of_word_suffix") or "", _ascii_pattern(spec)
        vocabulary = model["vocab"]
        self.strings = {i: t for t, i in vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens must be matched as they stand")
        self.strings |= {i: t for t, i in self.special.items()}
        # the longest of those that begin at one place
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # each merged token has one pair; its rank is when it comes to be
        self.pair: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {}
        for r, (a, b) in enumerate(map(tuple, (m if isinstance(m, list) else m.split(" ") for m in model["merges"]))):
            whole, left, right = vocabulary[a + b], vocabulary[a], vocabulary[b]
            if whole in self.pair or max(self.born.get(left, -1), self.born.get(right, -1)) >= r:
                raise ValueError("merges must build each token once, after its parts")
            self.pair[whole], self.rank[left, right], self.born[whole] = (left, right), r, r
        tokens = {}
        for t, i in vocabulary.items():
            ended = bool(self.end) and t.endswith(self.end) and len(t) > len(self.end)
            body = t[: -len(self.end)] if ended else t
            if i in self.pair or len(body) == 1:
                tokens[i] = symbols(body, ended)
        automaton = SuffixAutomaton(tokens)
        self.steps = Numbers()
        self.steps.add(np.fromiter(automaton.step.keys(), np.uint64, len(automaton.step)), np.fromiter(automaton.step.values(), np.int64, len(automaton.step)))
        self.length, self.link = np.array(automaton.length), np.array(automaton.link)
        self.token, self.next = np.array(automaton.token), np.array(automaton.next)
        most = max(self.strings) + 1
        self.size = np.zeros(most, np.int64)
        self.size[list(tokens)] = [len(c) for c in tokens.values()]
        self.ranks = Numbers()
        self.ranks.add(_pairs(*map(np.array, zip(*self.rank, strict=True))), np.array(list(self.rank.values()))) if self.rank else None
        self.edges = [self._edges(side, most) for side in (0, 1)]
        self.agree = Numbers()
        # what ids are shown as, a blank before each
        self.decimal, self.spelled = Pool(np.uint8), Pool(np.uint8)
        for pool, shown in ((self.decimal, map(str, range(most))), (self.spelled, (self.strings.get(i, "") for i in range(most)))):
            parts = [b" " + x.encode() for x in shown]
            pool.add(np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, most))

    def _edges(self, side: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, when each is merged away, where those of each token begin) down one side of the tokens' merges."""
        found: list[int] = []
        gone: list[int] = []
        first = [0]
        for t in range(most):
            until = NEVER
            while True:
                found.append(t)
                gone.append(until)
                if t not in self.pair:
                    break
                t, until = self.pair[t][side], self.born[t]
            first.append(len(found))
        return np.array(found), np.array(gone), np.array(first)

    def _apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Which pairs of tokens merging leaves apart: no right edge x and left edge y merge before they are gone."""
        (x, gone_x, at_x), (y, gone_y, at_y) = self.edges[1], self.edges[0]
        n, m = at_x[first + 1] - at_x[first], at_y[second + 1] - at_y[second]
        each = n * m
        pair = np.repeat(np.arange(len(first)), each)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
        i, j = at_x[first][pair] + k // m[pair], at_y[second][pair] + k % m[pair]
        r = self.ranks.find(_pairs(x[i], y[j]))
        joined = (r >= 0) & (r < gone_x[i]) & (r <= gone_y[j])
        return np.bincount(pair[joined], minlength=len(first)) == 0

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys = _pairs(first, second)
        known = self.agree.find(keys)
        if (known < 0).any():
            new, where = np.unique(keys[known < 0], return_index=True)
            where = np.flatnonzero(known < 0)[where]
            if self.agree.held > MOST_PAIRS:
                self.agree = Numbers()
            found = self._apart(first[where], second[where]).astype(np.int64)
            self.agree.add(new, found)
            missing = np.flatnonzero(known < 0)
            known[missing] = found[np.searchsorted(new, keys[missing])]
        return known > 0

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, how many each has). Words of about one length go on together, symbol by symbol."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum(n)
        if self.end:
            codes[ends - 1] += MARKED
        order = np.argsort(-n, kind="stable")
        sizes, parts, at = np.zeros(len(words), np.int64), [], 0
        while at < len(order):
            # as many words as a table of bounded size holds, the longest first
            rows = order[at : at + max(1, TABLE // (int(n[order[at]]) + 1))]
            at += len(rows)
            ids, count = self._together(codes, (ends - n)[rows], n[rows])
            sizes[rows] = count
            parts.append(ids)
        if not parts:
            return np.empty(0, np.int32), sizes
        given = sizes[order]
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(given) - given
        return spread(np.concatenate(parts), begin, sizes), sizes

    def _together(self, codes: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each has) of words, the longest first."""
        most = int(n[0])
        last = np.full((len(n), most + 1), -1, np.int32)  # last token of each prefix
        state, read = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)  # read: symbols that the state stands for just now
        going = np.searchsorted(-n, -np.arange(most + 1), side="right")  # words of at least so many symbols
        for at in range(1, most + 1):
            m = int(going[at])
            state, read = state[:m], read[:m]
            code = codes[starts[:m] + at - 1]
            to = self._step(state, code)
            lost = np.flatnonzero((to < 0) & (state > 0))
            while len(lost):
                state[lost] = self.link[state[lost]]
                read[lost] = self.length[state[lost]]
                to[lost] = self._step(state[lost], code[lost])
                lost = lost[(to[lost] < 0) & (state[lost] > 0)]
            state, read = np.maximum(to, 0), np.where(to < 0, 0, read + 1)
            # the longest string of a state may be longer than what was read
            s = np.where((self.token[state] >= 0) & (self.length[state] <= read), state, self.next[state])
            open_ = np.arange(m)
            while len(open_):
                here = s[open_]
                if not here.all():
                    raise ValueError(f"no token ends at {at} of a word")
                t = self.token[here]
                before = at - self.size[t]
                fits = before == 0
                inner = np.flatnonzero(~fits)
                fits[inner] = self.compatible(last[open_[inner], before[inner]].astype(np.int64), t[inner])
                last[open_[fits], at] = t[fits]
                open_ = open_[~fits]
                s[open_] = self.next[s[open_]]
        # back-pointers, all words at once
        at, row, taken = n.copy(), np.arange(len(n)), []
        while len(row):
            t = last[row, at[row]]
            taken.append((row, t))
            at[row] -= self.size[t]
            row = row[at[row] > 0]
        rows, ids = (np.concatenate(x) for x in zip(*reversed(taken), strict=True))
        return ids[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(n))

    def _step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.steps.find((state << STATE | code).astype(np.uint64))

    def _plain(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        normal = self.normalize.normalize_str(text) if self.normalize else text
        words = [w for w, _ in self.split.pre_tokenize_str(normal)] if self.split else [normal]
        return self.word_ids([w for w in words if w])[0]

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text; special tokens are found as they stand."""
        out, at = [], 0
        for m in self.specials.finditer(text) if self.specials else ():
            out += [self._plain(text[at : m.start()]), np.array([self.special[m.group()]], np.int32)]
            at = m.end()
        return np.concatenate([*out, self._plain(text[at:])])

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def decode(self, ids: list[int]) -> str:
        """As the library does for a file without a decoder: token strings with blanks between."""
        return " ".join(self.strings[i] for i in ids)

    def encode_many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, how many each has). Plain pieces are normalised and split together, with blanks between."""
        special = self.specials is not None and self.specials.search(" ".join(pieces)) is not None
        plain = np.array([p.isprintable() and " " not in p and not (special and self.specials.search(p)) for p in pieces], bool)
        ascii_ = plain & np.fromiter(map(str.isascii, pieces), bool, len(pieces)) if self.ascii_split else np.zeros(len(pieces), bool)
        sizes, begin, end = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), 0
        values: list[np.ndarray] = [np.empty(0, np.int32)]
        alone = ~plain
        for group, split in ((ascii_, self._split_ascii), (plain & ~ascii_, self._split_plain)):
            rows = np.flatnonzero(group)
            found = split([pieces[i] for i in rows]) if len(rows) else None
            if found is None:
                alone |= group
                continue
            ids, n = self.word_ids(found[0])
            sizes[rows] = np.bincount(found[1], weights=n, minlength=len(rows)).astype(np.int64)
            begin[rows] = end + np.cumsum(sizes[rows]) - sizes[rows]
            values.append(ids)
            end += len(ids)
        for i in np.flatnonzero(alone).tolist():
            ids = self.ids(pieces[i])
            values.append(ids)
            sizes[i], begin[i] = len(ids), end
            end += len(ids)
        return spread(np.concatenate(values), begin, sizes), sizes

    def _split_ascii(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """(words, piece of each) of ASCII pieces: normalising lower-cases them, and bytes stand for themselves."""
        found = self.ascii_split.findall(" ".join(pieces).lower())
        blank = np.fromiter(map(" ".__eq__, found), bool, len(found))
        return [w for w in found if w != " "], np.cumsum(blank)[~blank]

    def _split_plain(self, pieces: list[str]) -> tuple[list[str], np.ndarray] | None:
        joined = " ".join(pieces)
        normal = self.normalize.normalize_str(joined) if self.normalize else joined
        parts = normal.split(" ")
        if not self.split or len(parts) != len(pieces):
            return None
        words = self.split.pre_tokenize_str(normal)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        return [w for w, _ in words], np.searchsorted(ends, np.fromiter((x[0] for _, x in words), np.int64, len(words)), side="right")


def _ascii_pattern(spec: dict):
    """Words and blanks of lower-case printable ASCII, as the file's own splitter finds the words; None for files of other kinds."""
    normal, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    kinds = [(x["type"], x.get("content")) for x in normal.get("normalizers", [])]
    steps = split.get("pretokenizers", [])
    if kinds != [("NFC", None), ("Replace", " "), ("Lowercase", None)] or [x["type"] for x in steps] != ["Split", "ByteLevel"]:
        return None
    pattern, byte_level = steps[0]["pattern"].get("Regex"), steps[1]
    if not pattern or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or byte_level["add_prefix_space"] or byte_level.get("use_regex"):
        return None
    if normal["normalizers"][1]["pattern"].get("Regex") != r"\s+" or regex.search(pattern, " "):
        return None
    return regex.compile(f"(?:{pattern})| ")


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)


_loaded: dict[str, tuple[Bpe, WordTable]] = worker_cache(__name__)


def loaded(path: str) -> tuple[Bpe, WordTable]:
    """The encoder of a worker, and its table of ids of pieces."""
    if path not in _loaded:
        bpe = Bpe(path)

        def compute(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            # pieces hold no blanks
            found = [bpe.encode_many(b" ".join(pieces[at : at + MANY]).decode().split(" ")) for at in range(0, len(pieces), MANY)]
            ids, sizes = zip(*found, strict=True)
            return np.concatenate(ids), np.concatenate(sizes)

        _loaded[path] = bpe, WordTable(compute, np.int32)
    return _loaded[path]


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = loaded(path)
        for batch in batches:
            counts: list[int] = []
            shas: tuple[list[str], list[str]] = ([], [])
            going = None  # count and digests of a text that goes on
            for _, part, ended in _text.stretches(_text.texts(batch.column(1))):
                found = _text.words(part, BETWEEN, None)
                ids, first = known.gather(known.rows(found), found.first)
                sizes = np.diff(first)
                shown = [(spread(p.values, p.bounds[ids], w := p.bounds[ids + 1] - p.bounds[ids]), np.concatenate([[0], np.cumsum(w)])[first]) for p in (bpe.decimal, bpe.spelled)]
                if going or not ended:
                    n, both = going or (0, (hashlib.sha256(), hashlib.sha256()))
                    for sha, (text, _) in zip(both, shown, strict=True):
                        sha.update(memoryview(text)[0 if n else 1 :])  # the first id has no blank before it
                    going = n + len(ids), both
                    if ended:
                        counts.append(going[0])
                        for out, sha in zip(shas, both, strict=True):
                            out.append(sha.hexdigest())
                        going = None
                    continue
                counts += sizes.tolist()
                for out, (text, ends) in zip(shas, shown, strict=True):
                    view = memoryview(text)
                    out.extend(hashlib.sha256(view[min(a + 1, b) : b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            columns = [batch.column(0), pa.array(counts, pa.int64()), *(pa.array(x, pa.string()) for x in shas)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, known = loaded(path)
        for batch in batches:
            out = list(_tokens.coded(_text.texts(batch.column(1)), known))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of every document."""
    with_workers(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(tidy(_ids(path or vocabulary_path())), "doc_id bigint, ids array<int>")


def digest_documents(docs: DataFrame, path: str | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of ids and of the decoded text of every document."""
    with_workers(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(tidy(_digests(path or vocabulary_path())), SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
