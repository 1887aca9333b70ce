"""Nulls, empty and very long texts, repeated rows, empty tables, columns with clashing names."""

import bisect
import collections
import os
import random
import re

import numpy as np
import pytest

from linesets.llm import _components, _text, _tokens, bpe, language_id, licenses, line_dedup, merkle, ngram_join, ngram_lm, packing, shard_tree, va_search

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 977}x{i % 53}" for i in range(60_000))
ROWS = [
    (1, "the cat sat on the mat and then it slept all day", "en", "a", 47),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t\n ", "en", "a", 5),
    (5, "the cat sat on the mat and then it slept all day", "en", "a", 47),
    (5, "the cat sat on the mat and then it slept all day", "en", "a", 47),
    (None, "the cat sat on the mat and then it slept all day", "en", "a", 47),
    (None, None, None, "a", None),
    (6, LONG, "en", "b", len(LONG)),
    (7, "한국어 \U0001f600 é́ café ''s <|endoftext|> x", "ko", "b", 9),
    (8, "12 34 !!", "en", "b", 8),
    (9, "one", "en", "b", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


OPERATORS = {
    "fingerprints": merkle.fingerprints,
    "compare_next": merkle.compare_next,
    "classes": ngram_join.classes,
    "pack": packing.pack_documents,
    "digest": bpe.digest_documents,
    "encode": bpe.encode_documents,
    "lm": ngram_lm.score_documents,
    "licenses": licenses.scan_documents,
    "lines": line_dedup.dedup_lines,
    "shards": lambda df: shard_tree.assign(df, shard_tree.build()),
    "language": lambda df: language_id.identify(df, language_id.learn(df)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_rows(docs, name):
    found = OPERATORS[name](docs).collect()
    if name == "pack":
        assert {r["doc_id"] for r in found if r["piece"] == 0} == {r[0] for r in ROWS}
        assert sum(r["piece"] == 0 for r in found) == len(ROWS)
    else:
        assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).collect() == []


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns(spark, name):
    from pyspark.sql import functions as F

    few = spark.createDataFrame(ROWS[:5], DOCS)
    extra = ["_id", "_hash", "_cut", "id", "n", "tokens", "bucket", "high", "rank", "shard_", "length", "piece", "label", "_part", "span", "row", "body", "c0", line_dedup.N_CUT, language_id.LANG]
    odd = few.withColumns({c: F.lit(1) for c in extra})
    assert len(OPERATORS[name](odd).collect()) == 5


def test_pipeline_of_odd_rows(spark, docs, empty):
    import corpus_pipeline

    for table in (docs, empty):
        at = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, "")
            assert at.columns == table.columns, name
            at = spark.createDataFrame(at.collect(), DOCS)
        kept = at.select("doc_id", "text").collect()
        assert len(kept) == len(set(kept))
        corpus_pipeline.pack(spark, at, "").collect()
    ids = {r["doc_id"] for r in kept} if kept else set()
    assert not ids & {2, 3, 4, 8}


def test_lines_cut(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"a\nb\nc\nd\n{long}\nz"), (2, "x\na\nb\nc\nd\ny"), (3, f"q\n{long}\nz\nr"), (4, "a\nb"), (5, "b\nc\nd"), (6, "n\nn\nn\nn\nn\nn")]
    found = {r["doc_id"]: (r["text"], r[line_dedup.N_CUT]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[1] == (rows[0][1], 0)
    assert found[2] == ("x\ny", 4)
    assert found[3] == ("q\nr", 2)  # the short line after the long one agrees too
    assert found[4] == ("a\nb", 0)  # two short lines are no run
    assert found[5] == ("", 3)
    assert found[6] == ("n", 5)  # a run that overlaps its own first copy goes from there on


def brute_lines(texts: dict[int, str], window: int, long_words: int) -> dict[int, str]:
    """Every run of lines compared with all earlier ones."""
    lines = {d: t.split("\n") for d, t in texts.items()}
    n_words = lambda d, i, n: len(re.findall(r"[^ \t-\r]+", " ".join(lines[d][i : i + n])))
    first, cut = {}, set()
    for d in sorted(lines):
        for i in range(len(lines[d])):
            for n in range(1, min(window, len(lines[d]) - i) + 1):
                if n < window and (n_words(d, i, n) < long_words or any(n_words(d, k, n - 1) >= long_words for k in (i, i + 1)) and n > 1):
                    continue
                e, j = first.setdefault(tuple(lines[d][i : i + n]), (d, i))
                if (e, j) == (d, i):
                    continue
                low, high = 0, n
                while low > 1 - window and min(i, j) + low > 0 and lines[d][i + low - 1] == lines[e][j + low - 1]:
                    low -= 1
                while high < n + window - 1 and i + high < len(lines[d]) and j + high < len(lines[e]) and lines[d][i + high] == lines[e][j + high]:
                    high += 1
                cut |= {(d, k) for k in range(i + low, i + high)}
    return {d: "\n".join(x for i, x in enumerate(lines[d]) if (d, i) not in cut) for d in lines}


def test_lines_long_together(spark):
    one, two = " ".join(f"a{i}" for i in range(23)), " ".join(f"b{i}" for i in range(46))
    short = " ".join(f"c{i}" for i in range(3))
    rows = [(1, f"{one}\n{two}"), (2, f"{one}\n{two}"), (3, f"x\n{one}\n{two}\ny"), (4, f"{short}\n{two}"), (5, f"{two}\n{one}"), (6, f"q\n{short}\n{two}")]
    found = {r["doc_id"]: (r["text"], r[line_dedup.N_CUT]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {1: (rows[0][1], 0), 2: ("", 2), 3: ("x\ny", 2), 4: (rows[3][1], 0), 5: (rows[4][1], 0), 6: (rows[5][1], 0)}


@pytest.mark.parametrize(("window", "long_words"), [(3, 6), (4, 7), (2, 4), (1, 3)])
def test_lines_brute_force(spark, window, long_words):
    rng = random.Random(window)
    parts = [" ".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 4, 8]))) for _ in range(14)]
    texts = {d: "\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for d in range(120)}
    texts = {d: t for d, t in texts.items() if t}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame, window=window, long_words=long_words).collect()}
    assert found == brute_lines(texts, window, long_words)


def test_range_borders(spark):
    rng = random.Random(8)
    spread = [i * 7 for i in range(3000)]
    uneven = list(range(2000)) + [rng.randrange(-(2**63), 2**63) for _ in range(300)] + [2**40 + i for i in range(500)] + [2**62] * 400
    for ids, n in ((spread, 10), (uneven, 16), ([5] * 50, 4), ([], 4), ([-(2**63), 2**63 - 1], 2)):
        borders = merkle.range_borders(spark.createDataFrame([(i,) for i in ids], "doc_id bigint"), n)
        assert borders == sorted(set(borders))
        assert len(borders) < n
        sizes = collections.Counter(bisect.bisect_right(borders, i) for i in ids)
        share = -(-len(ids) // n)
        most = max(collections.Counter(ids).values(), default=0)
        assert max(sizes.values(), default=0) <= 2 * share + most


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["id"]: r["component"] for r in _components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def near_copies(n, rng, words=200, changed=8):
    base = [f"t{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for i in rng.sample(range(words), changed):
            copy[i] = f"u{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("blocks,hot,trees", [(3_000_000, 20_000_000, 20_000), (900, 20_000_000, 20_000), (900, 2, 5)])
def test_near_copies(spark, monkeypatch, blocks, hot, trees):
    """Large neighbourhoods in blocks, hot cells, and trees that are too full give the same classes."""
    from tests.llm.test_queries import brute_components

    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", blocks)
    monkeypatch.setattr(ngram_join, "HOT_CELL", hot)
    monkeypatch.setattr(ngram_join, "TREE_ROWS", trees)
    rng = random.Random(11)
    texts = [t for k in (30, 6, 2) for t in near_copies(k, rng, changed=rng.choice([2, 5]))] + near_copies(12, rng, changed=3)
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [" ".join(f"r{rng.randrange(10**6)}" for _ in range(150)) + " " + passage for _ in range(10)]
    texts += ["a b c d e f g h", "a b c d e f g h", "a b c", "A  b\tc", "a b", "", "x " * 500]
    rows = dict(enumerate(texts))
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.classes(df).collect()}
    assert got == brute_components(rows)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[: int(rng.integers(200, 300))], rng.integers(0, 2**63, 30, dtype=np.uint64)])) for s in sets]
    sizes = np.array([len(s) for s in sets])
    groups = ngram_join.groups_for(int(sizes.min()))
    points = ngram_join.count_vectors(sets, groups)
    tree = ngram_join.RTree(points, sizes)
    for i, s in enumerate(sets):
        near = set(tree.near(points[i], len(s)).tolist())
        linked = {j for j, t in enumerate(sets) if ngram_join.overlap(s, t) >= ngram_join.needed(len(s), len(t))}
        assert linked <= near
    assert sum(len(tree.near(points[i], len(s))) for i, s in enumerate(sets)) < 400


def test_va_search_edges(spark):
    rows = [
        (0, [0.5, -0.25, 0.1], 1), (50, [0.5, -0.25, 0.1], 1), (50, [0.1, 0.1, 0.1], 1), (1, [0.5, -0.25, 0.1], 1), (2, None, 1), (3, [None, 1.0, 2.0], 1),
        (4, [float("nan"), 1.0, 2.0], 1), (5, [float("inf"), 1.0, 2.0], 1), (None, [1.0, 1.0, 1.0], 1), (6, [2.0], 1), (100, [], 1), (7, [-1.0, 0.0, 3.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got = [tuple(r) for r in va_search.search(df, k=3).collect()]
    clean = [(i, np.floor(np.float32(v).astype(float) * 256).astype(int)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in (0, 50, 100):
        asked = min((list(v) for i, v in clean if i == q))
        score = sorted((-sum(a * b for a, b in zip(asked, v, strict=False)), i) for i, v in clean if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(score[:3], 1)]
    assert sorted(got) == sorted((q, r, i, int(s)) for q, r, i, s in want)
    assert va_search.search(df.limit(0)).collect() == []


def test_va_search_reads_few(spark, monkeypatch):
    """Exact vectors are read for few of the pairs, and those are enough."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    vectors = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) / 8
    exact = np.floor(256 * vectors).astype(np.int64)
    counts, read = [], va_search.read
    monkeypatch.setattr(va_search, "read", lambda found, *rest: counts.append(found.count()) or read(found, *rest))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id bigint, embedding array<double>")
    found = {}
    for r in va_search.search(df.repartition(3), every=400).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    scores = exact @ exact.T
    assert set(found) == set(range(0, 4000, 400))
    for q, got in found.items():
        want = sorted((-s, i) for i, s in enumerate(scores[q].tolist()) if i != q)[:5]
        assert [x[1:] for x in sorted(got)] == want
    assert len(counts) == 2
    assert sum(counts) < 10 * 4000 / 100


def test_va_bounds_hold():
    rng = np.random.default_rng(3)
    for scale, dims in ((1, 1), (300, 8), (10**6, 3), (10**12, 5), (2**62, 2)):
        exact = (rng.normal(size=(500, dims)) * scale).clip(-(2.0**62), 2.0**62).astype(np.int64)
        asked = exact[:20]
        middle, reach = va_search.bounds(asked, *va_search.approximate(exact))
        for q in range(len(asked)):
            for v in range(len(exact)):
                true = sum(int(a) * int(b) for a, b in zip(asked[q], exact[v], strict=True))
                assert middle[q, v] - reach[q] <= true <= middle[q, v] + reach[q]


def test_va_search_parts_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(700, 4)), 1)  # many ties
    exact = np.floor(256 * vectors).astype(np.int64)
    for name, n in (("PART_ROWS", 50), ("BLOCK_ROWS", 16), ("QUERY_ROWS", 3)):
        monkeypatch.setattr(va_search, name, n)
    df = spark.createDataFrame([(i, v, 1, 1, 1, "x") for i, v in enumerate(vectors.tolist())], "vec_id bigint, embedding array<double>, id int, v int, row int, rows string")
    got = sorted(tuple(r) for r in va_search.search(df, k=7, every=35).collect())
    want = []
    for q in range(0, 700, 35):
        best = sorted((-s, i) for i, s in enumerate((exact[q] @ exact.T).tolist()) if i != q)[:7]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_va_search_among_copies(spark, monkeypatch):
    """A third of the rows is one vector, with repeated ids among them; a query's candidates don't grow with it."""
    rng = np.random.default_rng(5)
    vectors = [(i, [1.0, 0.5, 0.25]) for i in range(0, 400)] + [(3, [1.0, 0.5, 0.25])] * 9 + [(0, [1.0, 0.5, 0.25])] * 7
    vectors += [(1000 + i, v) for i, v in enumerate(rng.normal(size=(500, 3)).tolist())]
    exact = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in vectors]
    counts, read = [], va_search.read
    monkeypatch.setattr(va_search, "read", lambda found, *rest: counts.append(found.count()) or read(found, *rest))
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").repartition(5)
    got = sorted(tuple(r) for r in va_search.search(df, every=100).collect())
    want = []
    asked = {i: v for i, v in exact if i % 100 == 0}
    for q, v in asked.items():
        best = sorted((-int(v @ w), i) for i, w in exact if i != q)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert sum(counts) < len(asked) * 40


def test_va_search_of_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [1e9, 2.0]), (50, [1e9, 1e9]), (1, [3.0, 4.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="too large for 64-bit scores"):
        va_search.search(df).collect()


def test_tokens_agree_with_the_library():
    from tokenizers import Tokenizer

    path = _tokens.vocabulary_path()
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(7)
    letters = "abcdeéàüñ's't 12.,!?-_<|>\n\t́‍字\U0001f642ÀÉΣİ\x00\x85　"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    texts += ["", " ", "\n", "a" * 5000, "<|startoftext|><|endoftext|>" * 3, "ΣΣΣ αΣ.", "Don't 'REally we'll x's", LONG]
    own, known = bpe.loaded(path)
    lib = list(_tokens.encode_all([t.encode() for t in texts], path))
    for t, ids in zip(texts, lib, strict=True):
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert own.encode(t) == want
        assert own.decode(want) == tokenizer.decode(want, skip_special_tokens=False)


def test_words_against_regex():
    import re

    rng = random.Random(9)
    texts = [bytes(rng.choice(b"abAB \t\n\r\x0b\x0c\x1c\xc3\xa9") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    found = _text.words(texts)
    seen = {}
    for i, t in enumerate(texts):
        want = re.findall(rb"[^\x20\x09-\x0D]+", t.lower())
        got = found.hash[found.first[i] : found.first[i + 1]].tolist()
        assert len(got) == len(want)
        for w, h in zip(want, got, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_license_expressions():
    def tag(e):
        return licenses.tags(b"// SPDX-License-Identifier: " + e.encode() + b"\nnext line")

    assert tag("MIT OR GPL-3.0-only") == [({"mit", "gpl-3.0-only"}, 1)]
    assert tag("MIT AND GPL-3.0-only") == [({"mit", "gpl-3.0-only"}, 3)]
    assert tag("GPL-2.0-only WITH Classpath-exception-2.0") == [({"gpl-2.0-only"}, 2)]
    assert tag("MIT AND (GPL-2.0-only OR BSD-3-Clause) */") == [({"mit", "gpl-2.0-only", "bsd-3-clause"}, 1)]
    assert tag("GPL-2.0-only OR MIT AND AGPL-3.0-only") == [({"gpl-2.0-only", "mit", "agpl-3.0-only"}, 3)]
    assert tag("") == tag("OR MIT") == tag("(MIT") == []
    assert tag("MIT OR") == tag("MIT )") == [({"mit"}, 1)]
    row = licenses.scan([b"Under CC-BY, cc by. All Rights   Reserved; accby cc byx"])[0]
    assert row[:6] == (11, 3, 1, 5, "cc-by,reserved", "cc-by,reserved")


def test_tree_growth_moves_rows_only_into_the_new_shard(spark):
    tree = shard_tree.build(2, 2, 3)
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    for _ in range(3):
        grown = shard_tree.grow(tree)
        n = len(shard_tree.leaves(tree))
        both = shard_tree.assign(shard_tree.assign(df, tree), grown, name="grown").collect()
        moved = [r for r in both if r["shard"] != r["grown"]]
        assert moved and all(r["grown"] == n for r in moved)
        assert 0.3 < len(moved) / (4000 / (n + 1)) < 2
        tree = grown


def test_shared_dir_is_read_from_the_session(spark):
    from linesets.llm import _common

    assert _common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert os.path.isdir(_common.shared_dir(spark))
