"""Arrays of a model in a shared folder that only a file system library opens."""

import numpy as np
from pyarrow import fs

from linesets.llm import ngram_lm


def test_arrays_are_fetched_and_mapped(tmp_path, monkeypatch):
    local = fs.LocalFileSystem()
    monkeypatch.setattr(ngram_lm, "_store", lambda path: (local, path.replace("other://", str(tmp_path))))
    for array in (np.arange(100_000, dtype=np.uint64), np.arange(10, dtype=np.int64).reshape(2, 5)):
        ngram_lm.save("other:///array", array)
        found = ngram_lm.load("other:///array", array.dtype)
        assert isinstance(found, np.memmap)
        assert (found == array.ravel()).all()
    assert [p.name for p in tmp_path.iterdir()] == ["array"]  # nothing staged is left
    assert len(ngram_lm.load("other:///none", np.uint64)) == 0


def test_an_unfinished_array_is_not_there(tmp_path):
    out = ngram_lm.Writer(f"file:{tmp_path}/some")
    out.add(np.arange(5))
    assert len(ngram_lm.load(f"file:{tmp_path}/some", np.int64)) == 0
    out.add(np.arange(5, 9))
    out.close()
    assert ngram_lm.load(f"file:{tmp_path}/some", np.int64).tolist() == list(range(9))


def test_layout_grows_with_the_text():
    for size in (0, 10**6, 10**9, 10**12, 10**14):
        how = ngram_lm.Layout.of(size, 1)
        tokens = size / 6 / how.buckets
        assert how.slots >= tokens / ngram_lm.SLOT_TOKENS  # a slot stays small
        assert how.buckets >= 8
    assert ngram_lm.Layout.of(10**14, 1).buckets < 10**6


def test_parts_of_hot_contexts():
    hot = np.array([5, 900], np.uint64)
    how = ngram_lm.Layout(1, 8, 4, hot.tobytes(), np.array([3, 7], np.uint64).tobytes())
    rng = np.random.default_rng(6)
    words = np.sort(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    for c, parts in ((5, 3), (900, 7), (6, 1)):
        stored = how.contexts(np.full(len(words), c, np.uint64), words)
        assert len(np.unique(stored)) == parts
        assert (np.diff(stored.astype(object)) != 0).sum() == parts - 1  # each part is one run of the sorted words
