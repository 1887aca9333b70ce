"""License scans: Aho-Corasick over words, shunting-yard over license expressions.

Texts are lower-cased (A-Z) and become streams of words (ASCII letters and
digits, and all of non-ASCII) with single blanks between. One automaton finds
every notice phrase and the identifier tag in the stream; a phrase starts and
ends at word borders because it carries the blanks around it. A tag's place in the stream
leads back to its place in the text, where, if its words are joined by hyphens and a colon follows,
there is an expression, which a shunting-yard parser turns to postfix and evaluates: `and` asks for all terms (the strictest rules), `or` leaves the choice
(the mildest), and `with` grants an exception, which softens a copyleft license.

Labels: those of phrases, plus spdx:<id> for each license of an expression and
terms:<level> for what it evaluates to. The score is the chance that at least one
finding is right, from a weight for each kind.

Null and empty texts have no words and no labels. Texts are scanned whole, however long, row
by row; repeated rows and other columns make no difference. An empty table gives no rows. Each
place of a phrase counts, so there are no ties to break.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesets.llm import _text
from linesets.llm._common import table, tidy, with_workers

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notice phrases of common licenses and their labels.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "apache license": "apache",
    "licensed under the apache": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc0": "cc0",
    "public domain": "public-domain",
    "this is free and unencumbered software": "unlicense",
}
TAG = "spdx license identifier"
TAG_TEXT, AFTER_TAG = b"spdx-license-identifier", re.compile(rb"[ \t]*:[ \t]*")
TOKEN = re.compile(rb"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")

# How strict a license is: 0 public domain, 1 permissive, 2 weak copyleft, 3 copyleft, 4 network copyleft.
LEVELS = ("free", "permissive", "weak-copyleft", "copyleft", "network-copyleft")
STRICTNESS = {
    "cc0-1.0": 0, "unlicense": 0, "0bsd": 0, "wtfpl": 0,
    "mit": 1, "apache-2.0": 1, "bsd-2-clause": 1, "bsd-3-clause": 1, "isc": 1, "zlib": 1, "bsl-1.0": 1, "cc-by-4.0": 1, "cc-by-3.0": 1,
    "mpl-2.0": 2, "lgpl-2.1": 2, "lgpl-2.1-only": 2, "lgpl-2.1-or-later": 2, "lgpl-3.0": 2, "lgpl-3.0-only": 2, "lgpl-3.0-or-later": 2, "epl-2.0": 2,
    "gpl-2.0": 3, "gpl-2.0-only": 3, "gpl-2.0-or-later": 3, "gpl-3.0": 3, "gpl-3.0-only": 3, "gpl-3.0-or-later": 3, "cc-by-sa-4.0": 3,
    "agpl-3.0": 4, "agpl-3.0-only": 4, "agpl-3.0-or-later": 4,
}
UNKNOWN_LEVEL = 3  # an unknown license counts as strict
PRECEDENCE = {"with": 3, "and": 2, "or": 1}
WEIGHTS = {"base": 0.5, "notice": 0.6, "tag": 0.9}


def strictness(name: str) -> int:
    return STRICTNESS.get(name.removesuffix("+"), UNKNOWN_LEVEL)


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: the longest well-formed expression that the tokens start with, in postfix.

    Empty if there is none. Operators of equal precedence go left to right.
    """
    depth, end, want, i = 0, 0, True, 0
    for i, t in enumerate(tokens):
        if want:
            if t == "(":
                depth += 1
            elif t in PRECEDENCE or t == ")":
                break
            else:
                want = False
        elif t in PRECEDENCE:
            want = True
        elif t == ")" and depth:
            depth -= 1
        else:
            break
        if not want and not depth:
            end = i + 1
    out: list[str] = []
    stack: list[str] = []
    for t in tokens[:end]:
        if t == "(":
            stack.append(t)
        elif t == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif t in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[t]:
                out.append(stack.pop())
            stack.append(t)
        else:
            out.append(t)
    return out + stack[::-1]


def evaluate(expression: list[str]) -> tuple[set[str], int] | None:
    """(licenses, level) of a postfix expression; None if `with` has no plain terms."""
    stack: list[tuple[set[str], int, bool]] = []  # licenses, level, plain term
    for t in expression:
        if t not in PRECEDENCE:
            stack.append(({t.removesuffix("+")}, strictness(t), True))
            continue
        right, left = stack.pop(), stack.pop()
        if t == "with":
            if not (left[2] and right[2]):
                return None
            # an exception is no license of its own; it opens a copyleft by one level
            stack.append((left[0], left[1] - (left[1] > 1), False))
        else:
            stack.append((left[0] | right[0], (max if t == "and" else min)(left[1], right[1]), False))
    return stack[0][:2] if stack else None


def expression(raw: bytes, end: int) -> tuple[set[str], int] | None:
    """What the expression behind a tag that ends there evaluates to; None if the text holds no whole tag or expression."""
    after = AFTER_TAG.match(raw, end)
    if not after or raw[max(0, end - len(TAG_TEXT)) : end].lower() != TAG_TEXT:
        return None
    at, tokens = after.end(), []
    while t := TOKEN.match(raw, at):
        tokens.append(t[1].decode().lower())
        at = t.end()
    return evaluate(postfix(tokens))


def tags(raw: bytes) -> list[tuple[set[str], int]]:
    """What the expressions behind a text's tags evaluate to."""
    found = stream([raw])
    ends = [end for end, (phrase, _) in automaton().iter(found.text) if phrase == TAG]
    return [x for e in ends if (x := expression(raw, found.place(0, e))) is not None]


WORD = np.zeros(256, dtype=bool)  # True: part of a word
WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
WORD[128:] = True


@dataclass
class Stream:
    """Words of all texts: each text is a newline, a blank, and its words with a blank after each."""

    text: str
    heads: np.ndarray  # where each text starts
    n_words: np.ndarray  # of each text
    keep: np.ndarray  # which bytes of the texts, two more before and one after each, are in the stream
    begin: np.ndarray  # where each text starts among those
    kept: np.ndarray | None = None

    def place(self, doc: int, at: int) -> int:
        """Offset in a text of what stands in the stream."""
        if self.kept is None:
            self.kept = np.flatnonzero(self.keep)
        return int(self.kept[at] - self.begin[doc]) - 2


def stream(part: list[bytes]) -> Stream:
    raw = _text.LOWER[np.frombuffer(b"".join([b"\n " + t + b" " for t in part]), dtype=np.uint8)]
    sizes = np.fromiter((len(t) + 3 for t in part), np.int64, len(part))
    heads = np.cumsum(sizes) - sizes
    word = WORD[raw]
    before = np.concatenate([[False], word[:-1]])
    out = np.where(word, raw, np.uint8(32))
    keep = word | before
    keep[heads] = keep[heads + 1] = True
    out[heads] = 10
    starts = np.concatenate([[0], np.cumsum(word & ~before)])
    moved = np.cumsum(keep) - keep
    return Stream(out[keep].tobytes().decode("latin-1"), moved[heads], starts[heads + sizes] - starts[heads], keep, heads)


_automata: dict[int, object] = {}


def automaton():
    if 0 not in _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for phrase, label in (*BASE.items(), *NOTICES.items(), (TAG, "")):
            a.add_word(f" {phrase} ", (phrase, label))
        a.make_automaton()
        _automata[0] = a
    return _automata[0]


COLUMNS = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
    "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
}
SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan(part: list[bytes]) -> list[tuple]:
    """A row of COLUMNS for each text."""
    found = stream(part)
    heads, shown = found.heads, found.text
    hits: dict[int, list[tuple[str, str, int]]] = {}
    for end, (phrase, label) in automaton().iter(shown):
        at = end - len(phrase) - 1
        doc = int(np.searchsorted(heads, at, side="right")) - 1
        hits.setdefault(doc, []).append((phrase, label, at))
    rows = []
    for doc, n in enumerate(found.n_words.tolist()):
        if doc not in hits:
            rows.append((n, 0, None, None, "", "", 0.0))
            continue
        places, base, labels, wrong = [], set(), set(), 1.0
        last_at, count = int(heads[doc]) + 1, 0
        for phrase, label, at in sorted(hits[doc], key=lambda h: h[2]):
            if phrase == TAG:
                value = expression(part[doc], found.place(doc, at + len(phrase) + 1))
                if value is not None:
                    labels |= {f"spdx:{x}" for x in value[0]} | {f"terms:{LEVELS[value[1]]}"}
                    wrong *= 1 - WEIGHTS["tag"]
                continue
            labels.add(label)
            if phrase in BASE:
                count += shown.count(" ", last_at, at)
                last_at = at
                places.append(count)
                base.add(label)
            wrong *= 1 - WEIGHTS["base" if phrase in BASE else "notice"]
        ends = (min(places), max(places)) if places else (None, None)
        rows.append((n, len(places), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - wrong))
    return rows


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r for _, part in _text.slices(_text.texts(batch.column(1))) for r in scan(part)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(COLUMNS)
        found = [pa.array(c, t) for c, t in zip(columns, COLUMNS.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=["doc_id", *COLUMNS])


def scan_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    with_workers(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(_scan), SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))


_BASE_VALUES = ", ".join(f"({phrase.split()!r}, {label!r})" for phrase, label in BASE.items())
#: The base columns; the method's own labels and the score are beyond SQL.
BASE_SQL = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
p as (select * from (values {_BASE_VALUES}) t(phrase, label)),
h as (select doc_id, i - 1 as at, label from (select doc_id, w, unnest(range(1, len(w) + 1)) i from d), p where w[i:i + len(phrase) - 1] = phrase)
select d.doc_id, len(w) n_words, count(h.at) n_base, min(h.at) first_word, max(h.at) last_word,
    coalesce(string_agg(distinct label, ',' order by label), '') base_labels
from d left join h on d.doc_id = h.doc_id group by d.doc_id, w
"""
