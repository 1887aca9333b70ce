"""Token ids of whole texts by the tokenizers library, a text at a time or a table of its pieces.

Spaces and newlines never join a token, and no step of the tokenizer (NFC,
lower-casing, splitting, merging, special tokens) looks across one, so a text's
ids are those of its pieces in turn.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np

from linesets.llm import _text
from linesets.llm._common import worker_cache
from linesets.llm._wordtable import BETWEEN, WordTable

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_tables: dict[str, WordTable] = worker_cache("linesets.llm.packing")


def ids_table(path: str) -> WordTable:
    """Ids of pieces; one a worker for each vocabulary."""
    if path not in _tables:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def compute(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            out: list[list[int]] = []
            for at in range(0, len(pieces), 2048):  # the library's results are large
                coded = tokenizer.encode_batch_fast([p.decode() for p in pieces[at : at + 2048]], add_special_tokens=False)
                out += [e.ids for e in coded]
            sizes = np.fromiter(map(len, out), np.int64, len(out))
            return np.fromiter(itertools.chain.from_iterable(out), np.uint32, int(sizes.sum())), sizes

        _tables[path] = WordTable(compute, np.uint32)
    return _tables[path]


def coded(texts: list[bytes | None], known: WordTable) -> Iterator[np.ndarray]:
    """Ids of each text from a table of pieces; null is empty. A long text is worked on in parts."""
    held: list[np.ndarray] = []  # of a text that goes on
    for _, part, ended in _text.stretches(texts):
        found = _text.words(part, BETWEEN, None)
        ids, first = known.gather(known.rows(found), found.first)
        if held or not ended:
            held.append(ids)
            if ended:
                yield np.concatenate(held)
                held = []
            continue
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield ids[a:b]


def encode_all(texts: list[bytes | None], path: str) -> Iterator[np.ndarray]:
    """Unsigned 32-bit ids of each text."""
    return coded(texts, ids_table(path))
