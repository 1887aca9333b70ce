"""Words whose bytes are made to collide, very long texts and words, and many special tokens in one piece."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from linesets.llm import _text, _tokens, bpe, ngram_join, ngram_lm, packing
from linesets.llm._wordtable import WordTable
from tests.llm.test_queries import brute_components

DOCS = "doc_id bigint, text string"


def thue_morse(n):
    """Words of 2^n letters that every polynomial hash modulo 2^64 takes for equal from 1024 letters on."""
    one, two = "a", "b"
    for _ in range(n):
        one, two = one + two, two + one
    return one, two


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(_tokens.vocabulary_path())


def test_hashes_differ():
    rng = random.Random(4)
    spelled = {bytes(rng.randrange(97, 100) for _ in range(rng.randrange(1, 200))) for _ in range(20_000)}
    spelled |= {w.encode() for n in range(13) for w in thue_morse(n)}
    spelled = sorted(spelled)
    found = _text.words([b" ".join(spelled)])
    assert len(set(found.hash.tolist())) == len(spelled)
    assert found.spelled(np.arange(len(spelled))) == spelled
    assert _text.words([b" ".join(spelled)], key=5).hash.tolist() != found.hash.tolist()


def test_windows_end_between_words(monkeypatch):
    rng = random.Random(5)
    text = " ".join("x" * rng.choice([1, 2, 7, 8, 9, 30, 400]) + str(rng.randrange(1000)) for _ in range(3000)).encode()
    whole = _text.words([text, b"", text[:77]])
    for size in (1, 10, 100, 1000):
        monkeypatch.setattr(_text, "WINDOW_BYTES", size)
        cut = _text.words([text, b"", text[:77]])
        assert cut.hash.tolist() == whole.hash.tolist() and cut.first.tolist() == whole.first.tolist()


def test_stretches():
    texts = [b"a b", None, b"x " * 50, b"", b"long" * 30, b"c\nd" * 9 + b" " + b"y" * 70 + b" z"]
    for limit in (1, 7, 20, 1000):
        whole, open_ = [b""] * len(texts), False
        for first, part, ended in _text.stretches(texts, limit):
            for i, t in enumerate(part):
                whole[first + i] += t
            assert ended or len(part) == 1
            if not ended:
                assert part[0][-1:] in (b" ", b"\n")
            open_ = not ended
        assert whole == [t or b"" for t in texts] and not open_


def test_colliding_hashes_in_a_table():
    """With one hash for all words the table still tells them apart."""
    table = WordTable(lambda ws: (np.array([int(w) for w in ws], np.int64), np.ones(len(ws), np.int64)), np.int64, entries=50)
    rng = random.Random(6)
    for _ in range(30):
        numbers = [rng.randrange(10 ** rng.randrange(1, 18)) for _ in range(40)]
        found = _text.words([b" ".join(str(n).encode() for n in numbers)])
        found.hash[:] = found.hash % np.uint64(3)
        ids, first = table.gather(table.rows(found), found.first)
        assert ids.tolist() == numbers and first.tolist() == [0, 40]


def test_operators_on_colliding_words(spark, library):
    pairs = [thue_morse(n) for n in (10, 11, 12)]
    rows = [(2 * i + j, w) for i, p in enumerate(pairs) for j, w in enumerate(p)]
    rows += [(10 + i, f"k l m n {w}") for i, w in enumerate(pairs[1])] + [(20 + i, " ".join(p * 3)) for i, p in enumerate(pairs)]
    docs = spark.createDataFrame(rows, DOCS)
    coded = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows}
    for r in bpe.digest_documents(docs).collect():
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, coded[r["doc_id"]])).encode()).hexdigest()
    for r in packing.pack_documents(docs).collect():
        part = [*coded[r["doc_id"]], 1][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.classes(docs).collect()}
    assert got == brute_components(dict(rows))
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    train = [w for (_, t), h in zip(rows, held, strict=True) if not h for w in [*t.split(), ""]]
    for r in ngram_lm.score_documents(docs).collect():
        words = [*dict(rows)[r["doc_id"]].split(), ""]
        assert (r["n_known"], r["train_tokens"]) == (sum(w in train for w in words), len(train))


def test_special_tokens_in_one_piece(spark, library):
    texts = ["<|endoftext|>" * 5000, "a<|endoftext|><|startoftext|>b" * 700, "x<|endoftext" + "|>" * 30, "<|endoftext|> " * 50]
    found = {r["doc_id"]: r for r in bpe.digest_documents(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_a_text_of_fifty_megabytes(library):
    """In a worker's functions: what a stretch leaves open is taken up by the next one."""
    some = [f"w{i % 9973}x{i % 53} don't" for i in range(40_000)]
    line = " ".join(some) + "\n" + "z" * 70_000 + " " + "12.5,x" * 9000 + "\n"
    text = (line * (50_000_000 // len(line) + 1)).encode()
    assert len(text) >= 50_000_000
    once = library.encode(line, add_special_tokens=False).ids
    want = once * (len(text) // len(line))
    own, known = bpe.loaded(_tokens.vocabulary_path())
    for ids in (next(_tokens.coded([text], known)), next(_tokens.encode_all([text], _tokens.vocabulary_path()))):
        assert len(ids) == len(want) and ids.tolist() == want
    shingles = ngram_join.shingle_sets([text])[0]
    words = line.lower().split()
    cycle = words + words[:4]
    assert len(shingles) == len({tuple(cycle[i : i + 5]) for i in range(len(words))})


def test_only_files_without_a_decoder(tmp_path):
    import json

    spec = json.load(open(_tokens.vocabulary_path(), encoding="utf-8"))
    spec["decoder"] = {"type": "BPEDecoder", "suffix": "</w>"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="decoder"):
        bpe.Bpe(str(path))
