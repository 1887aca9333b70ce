"""Each opN query over whole tables at sf0.001, against SQL or a brute-force version."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from linesets.llm import _tokens, language_id, licenses, line_dedup, merkle, ngram_join, ngram_lm, packing, queries, shard_tree

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return dict(duck.sql("select doc_id, coalesce(text, '') from documents").fetchall())


def rows(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, duck, name):
    mine = queries.QUERIES[name](spark, SF)
    names = sorted(mine.columns)
    want = duck.sql(queries.ORACLE[name])
    assert sorted(want.columns) == names
    got = sorted(map(str, map(tuple, mine.select(*names).collect())))
    assert got == sorted(map(str, want.select(*names).fetchall()))


def test_merkle(spark, duck, docs):
    found = {r["doc_id"]: r for r in rows(spark, "op2_merkle_fingerprint")}
    edits = {r[0]: r[1:] for r in duck.sql(merkle.EDIT_SQL).select("doc_id", "n_chars", "edited_sha256").fetchall()}
    order = sorted(docs, reverse=True)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    assert set(found) == set(docs)
    for i, r in found.items():
        assert (r["n_chars"], r["edited_sha256"]) == edits[i]
        own, edited = merkle.build(docs[i]), merkle.build(merkle.edited(docs[i], docs[following[i]]))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (merkle.show(own), merkle.show(edited))
        assert merkle.parse(r["fingerprint"]) == own
        assert r["near_edited"] == merkle.likeness(own, edited)
        assert r["near_next"] == merkle.likeness(own, merkle.build(docs[following[i]]))
    by_text = collections.defaultdict(set)
    for i, t in docs.items():
        by_text[t].add(found[i]["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())


def brute_components(docs):
    sets = {}
    for d, t in docs.items():
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in docs}


def test_ngram_join(spark, docs):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(spark, "op3_ngram_join")}
    assert found == brute_components(docs)


def check_packing(found, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(_tokens.vocabulary_path())
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(docs)
    for d, parts in by_doc.items():
        ids = [*tokenizer.encode(docs[d], add_special_tokens=False).ids, 1]
        parts.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(-(-len(ids) // 4096)))
        for r in parts:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == 4096 * r["piece"]
            assert len(part) == r["length"] == min(4096, len(ids) - r["start"])
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    return len(by_sequence), -(-sum(r["length"] for r in found) // 4096)


def test_packing(spark, docs):
    sequences, least = check_packing(rows(spark, "op4_best_fit_packing"), docs)
    assert sequences <= least + 2


def test_language_id(spark, duck):
    labels = dict(duck.sql("select doc_id, lang from documents").fetchall())
    found = rows(spark, "op5_language_id")
    assert {r["doc_id"] for r in found} == set(labels)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held)


def brute_shard(key, tree):
    import xxhash

    while tree.children:
        draws = []
        for i, c in enumerate(tree.children):
            bits = xxhash.xxh64_intdigest(f"{key}:{c.name}", seed=42) >> 11
            draws.append((math.log((bits + 0.5) / (1 << 53)) / c.total(), i))
        tree = tree.children[max(draws)[1]]
    return tree.shard


def test_shard_tree(spark, docs):
    found = rows(spark, "op6_shard_tree")
    tree = shard_tree.build()
    grown = shard_tree.grow(tree)
    by_shard = collections.defaultdict(list)
    for r in found:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r["shard"] == brute_shard(r["doc_id"], tree)
        assert r["grown_shard"] == brute_shard(r["doc_id"], grown)
        assert r["grown_shard"] in (r["shard"], 24)
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def brute_lm(docs):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    coded = {d: [*words(t), None] for d, t in docs.items()}
    one, two = collections.Counter(), collections.Counter()
    for d, t in coded.items():
        if not held[d]:
            one.update(t)
            two.update(zip(["<start>", *t], t, strict=False))
    total, kinds, after = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0, 0]), collections.Counter()
    for (h, w), n in two.items():
        total[h] += n
        kinds[h][min(n, 3)] += 1
        after[w] += 1

    def ds(c):
        return ngram_lm.discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)])

    high, low = ds(two), ds(after)
    continuations, size = sum(after.values()), len(one) + 1
    left = sum(low[min(v, 3)] for v in after.values()) / max(continuations, 1)

    def p(h, w):
        below = max(after[w] - low[min(after[w], 3)], 0) / max(continuations, 1) + left / size
        if not total[h]:
            return below
        n = two[h, w]
        return (max(n - high[min(n, 3)], 0) + sum(high[k] * kinds[h][k] for k in (1, 2, 3)) * below) / total[h]

    n = sum(one.values())
    for d, t in coded.items():
        base = sum(math.log10((one[w] + 1) / (n + size)) for w in t)
        score = sum(math.log10(p(h, w)) for h, w in zip(["<start>", *t], t, strict=False))
        yield d, (held[d], len(t), sum(one[w] > 0 for w in t), n, base, score)
    some = next(iter(total))
    assert abs(sum(p(some, w) for w in one) + p(some, "never seen") - 1) < 1e-9


def test_language_model(spark, docs):
    want = dict(brute_lm(docs))
    found = rows(spark, "op8_kneser_ney")
    assert len(found) == len(want)
    for r in found:
        held, n, known, train, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-9)
    out = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(_tokens.vocabulary_path())
    found = rows(spark, "op9_bpe")
    assert {r["doc_id"] for r in found} == set(docs)
    for r in found:
        ids = tokenizer.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_licenses(spark, duck):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    found = rows(spark, "op10_license_scan")
    want = sorted(duck.sql(licenses.BASE_SQL).select(*names).fetchall())
    assert sorted(tuple(r[n] for n in names) for r in found) == want
    for r in found:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def brute_pipeline(spark, docs_rows):
    """run() by other means: one text at a time, all pairs, the tokenizers library."""
    model = language_id.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    kept = {r["doc_id"]: r["text"] for r in docs_rows if language_id.predict(model, [r["text"].encode() if r["text"] else None])[0][0] != "und"}
    lines = {d: t.split("\n") for d, t in kept.items()}
    first, cut = {}, set()
    places = [(d, i) for d in sorted(lines) for i in range(len(lines[d]))]
    units = []
    for d, i in places:
        x = lines[d]
        if i + line_dedup.WINDOW <= len(x):
            units.append((d, i, line_dedup.WINDOW))
        words = [len(re.findall(r"[^\x20\x09-\x0D]+", y)) for y in x[i : i + 2]]
        if words[0] >= line_dedup.LONG_WORDS:
            units.append((d, i, 1))
        if max(words) < line_dedup.LONG_WORDS <= sum(words):
            units.append((d, i, 2))
    for d, i, n in units:
        key = tuple(lines[d][i : i + n])
        if key not in first:
            first[key] = (d, i)
            continue
        e, j = first[key]
        a, b = 0, 0
        while a < line_dedup.WINDOW - 1 and i > a and j > a and lines[d][i - a - 1] == lines[e][j - a - 1]:
            a += 1
        while b < line_dedup.WINDOW - 1 and i + n + b < len(lines[d]) and j + n + b < len(lines[e]) and lines[d][i + n + b] == lines[e][j + n + b]:
            b += 1
        cut |= {(d, k) for k in range(i - a, i + n + b)}
    left = {d: "\n".join(x for i, x in enumerate(ls) if (d, i) not in cut) for d, ls in lines.items()}
    left = {d: t for d, t in left.items() if t.strip() or not any((d, i) in cut for i in range(len(lines[d])))}
    return {d: left[d] for d, (_, c) in brute_components(left).items() if c == d}


def test_pipeline(spark, duck):
    import corpus_pipeline

    documents = [dict(zip(("doc_id", "text"), r, strict=True)) for r in duck.sql("select doc_id, text from documents").fetchall()]
    want = brute_pipeline(spark, documents)
    assert len(want) < len(documents)
    check_packing([r.asDict() for r in corpus_pipeline.run(spark, SF).collect()], want)
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, SF).columns == columns


def test_packing_of_random_lengths():
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = rng.integers(1, 65, 200).tolist() + [64] * int(rng.integers(0, 5))
        counts = collections.Counter(lengths)
        plan = packing.plan(counts, 64)
        ns = np.repeat(list(counts), list(counts.values()))
        ranks = np.concatenate([np.arange(c) for c in counts.values()])
        sequence, offset = plan.place(ns, ranks)
        assert plan.sequences >= -(-sum(lengths) // 64)
        for s in range(plan.sequences):
            parts = sorted((o, n) for o, n, x in zip(offset.tolist(), ns.tolist(), sequence.tolist(), strict=True) if x == s)
            assert parts[0][0] == 0
            assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
            assert sum(parts[-1]) <= 64


def test_shingles_of_short_texts():
    sets = ngram_join.shingle_sets([b"", b" \n", b"One two", b"one  two", b"two one", b"a b c d e", b"a b c d e f a b c d e"])
    assert [len(s) for s in sets] == [0, 0, 1, 1, 1, 1, 6]
    assert sets[2] == sets[3] != sets[4]
