"""Fingerprint likeness, language scores, license labels and scratch tables against independent versions."""

import collections
import os
import random
import re

import duckdb
import numpy as np
import pytest

from linesets.llm import _common, bpe, language_id, licenses, line_dedup, merkle, ngram_join, ngram_lm, packing, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall())


def pieces(text):
    """What a tree's leaves stand for, cut code point by code point."""
    out = []
    for line in text.split("\n"):
        piece = ""
        for c in line:
            piece += c
            border = c == " " and len(piece) > 1 and ord(piece[-2]) < 65536 and ord(piece[-2]) % merkle.EVERY == merkle.BORDER
            if border or len(piece) == merkle.PIECE:
                out.append(piece)
                piece = ""
        if piece:
            out.append(piece)
    return collections.Counter(out)


def brute_likeness(a, b):
    if a == b:
        return 1.0
    ours, theirs = pieces(a), pieces(b)
    total = sum(len(p) * n for x in (ours, theirs) for p, n in x.items())
    return 2 * sum(len(p) * n for p, n in (ours & theirs).items()) / total if total else (1.0 if a.count("\n") == b.count("\n") else None)


def test_likeness(spark, documents):
    order = sorted(documents, reverse=True)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    for r in queries.QUERIES["op2_merkle_fingerprint"](spark, SF).collect():
        own, other = documents[r["doc_id"]], documents[following[r["doc_id"]]]
        half = len(own) // 2
        want = brute_likeness(own, own[: len(own) - half] + other[:half]), brute_likeness(own, other)
        for got, w in zip((r["near_edited"], r["near_next"]), want, strict=True):
            assert w is None or got == pytest.approx(w, abs=1e-12)


def test_pieces_after_an_insertion():
    """One word inserted early in a long line leaves nearly all later pieces as they are."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    own, other = " ".join(words), " ".join([*words[:10], "inserted", *words[10:]])
    assert merkle.likeness(merkle.build(own), merkle.build(other)) > 0.95
    assert merkle.likeness(merkle.build("x" * 5000), merkle.build("x" * 2560 + "y" * 2440)) > 0.4


def test_borders_up_to(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    for n in (0, 1, 2, 7, 8, 100):
        borders = sorted({rng.randrange(-50, 50) for _ in range(n)})
        for r in spark.range(-60, 60).select("id", merkle.borders_up_to(borders, F.col("id")).alias("n")).collect():
            assert r["n"] == sum(b <= r["id"] for b in borders)


def spectrum(text):
    """1- to 3-grams of the bytes, lower-cased, blanks as spaces."""
    raw = bytes(32 if b in b" \t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in text)
    return {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}


def test_kernel_ridge_regression(documents):
    """Scores are those of kernel ridge regression on Nystroem features, from sets of n-grams and a plain solve."""
    langs = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    rows = [(t.encode(), langs[i]) for i, t in sorted(documents.items()) if t and langs[i] and len(t) < 3000][:60]
    train, asked = rows[:45], [t for t, _ in rows[45:]]
    model = language_id.train(train, landmarks=16, ridge=0.1)
    labels = sorted({x for _, x in train})
    by_label = {x: [t for t, y in train if y == x] for x in labels}
    chosen = []
    for i in range(45):
        chosen += [ts[i] for ts in by_label.values() if i < len(ts)]
    chosen = list(dict.fromkeys(chosen))[:16]
    known = set().union(*map(spectrum, chosen))
    held = {t: spectrum(t) & known for t in {*chosen, *asked, *(t for t, _ in train)}}
    kernel = lambda a, b: len(held[a] & held[b]) / np.sqrt(max(len(held[a]), 1) * max(len(held[b]), 1))
    among = np.array([[kernel(a, b) for b in chosen] for a in chosen])
    values, vectors = np.linalg.eigh(among)
    root = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    x = np.array([[kernel(t, c) for c in chosen] for t, _ in train]) @ root
    y = np.array([[1.0 if label == k else -1.0 for k in labels] for _, label in train])
    w = np.array([len(train) / len(labels) / len(by_label[label]) for _, label in train])
    # a bias that isn't punished: weighted least squares with a column of ones
    wide = np.column_stack([x, np.ones(len(x))])
    punish = 0.1 * np.eye(wide.shape[1])
    punish[-1, -1] = 0
    beta = np.linalg.solve(wide.T @ (w[:, None] * wide) + punish, wide.T @ (w[:, None] * y))
    want = np.column_stack([np.array([[kernel(t, c) for c in chosen] for t in asked]) @ root, np.ones(len(asked))]) @ beta
    assert model.labels == labels
    assert np.abs(model.scores(asked) - want).max() < 2e-3


def brute_license(text):
    """Labels and score by words and regular expressions."""
    lower = text.translate(str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)}))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    labels, wrong = set(), 1.0
    for phrase, label in {**licenses.BASE, **licenses.NOTICES}.items():
        p = phrase.split()
        n = sum(words[i : i + len(p)] == p for i in range(len(words)))
        if n:
            labels.add(label)
            wrong *= (1 - (0.5 if phrase in licenses.BASE else 0.6)) ** n
    for m in re.finditer(r"(?<![0-9a-z\x80-\U0010ffff])spdx-license-identifier[ \t]*:[ \t]*([^\n]*)", lower):
        terms = re.match(r"([a-z0-9.+-]+)((?: (?:or|and) [a-z0-9.+-]+)*)", m[1])
        if not terms:
            continue
        # without brackets or exceptions: the mildest of what `or` joins, each the strictest of what `and` joins
        parts = [[x.strip() for x in part.split(" and ")] for part in terms[0].split(" or ")]
        labels |= {f"spdx:{x.removesuffix('+')}" for part in parts for x in part}
        labels.add(f"terms:{licenses.LEVELS[min(max(licenses.strictness(x) for x in part) for part in parts)]}")
        wrong *= 1 - 0.9
    return ",".join(sorted(labels)), 1 - wrong


def test_license_labels(spark, documents):
    rng = random.Random(5)
    names = [n for n in licenses.STRICTNESS] + ["custom-1.0"]
    phrases = [*licenses.BASE, *licenses.NOTICES]
    made = {}
    for i in range(300):
        parts = [rng.choice(phrases).replace(" ", rng.choice([" ", "-", ", ", "\n"])) for _ in range(rng.randrange(3))]
        if rng.random() < 0.6:
            terms = rng.choice(names)
            for _ in range(rng.randrange(4)):
                terms += rng.choice([" OR ", " AND "]) + rng.choice(names)
            parts.append(rng.choice(["", "x", "é", "# "]) + f"SPDX-License-Identifier: {terms.upper() if rng.random() < 0.5 else terms}\n")
        made[10**6 + i] = " .. ".join(rng.sample(parts, len(parts)))
    rows = documents | made
    found = {r["doc_id"]: r for r in licenses.scan_documents(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")).collect()}
    assert set(found) == set(rows)
    for i, t in rows.items():
        labels, score = brute_license(t)
        assert found[i]["labels"] == labels, t
        assert found[i]["score"] == pytest.approx(score, abs=1e-12)


RESULTS = {"packed", "lm-scores", "classes", "line-cuts", "va-results", "shards"}


def test_nothing_but_results_stays(spark, tmp_path, monkeypatch):
    """The shared folder holds no scratch tables, models or stages when an operator has given its result."""
    import corpus_pipeline

    monkeypatch.setattr(_common, "shared_dir", lambda spark: str(tmp_path))
    names = lambda: os.listdir(tmp_path / "linesets") if (tmp_path / "linesets").exists() else []
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for run in (packing.pack_documents, ngram_lm.score_documents, ngram_join.classes, line_dedup.dedup_lines, bpe.digest_documents):
        assert run(docs).count() > 0
    for name in ("op1_va_search", "op6_shard_tree"):
        assert queries.QUERIES[name](spark, SF).count() > 0
    assert {n.rsplit("-", 1)[0] for n in names()} <= RESULTS
    before = set(names())
    corpus_pipeline.run(spark, SF).count()
    assert [n.rsplit("-", 1)[0] for n in names() if n not in before] == ["pipeline"]


def test_scratch_goes_when_a_step_fails(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_common, "shared_dir", lambda spark: str(tmp_path))
    with pytest.raises(ZeroDivisionError), _common.scratch(spark):
        assert _common.materialize(spark.range(3), "some").count() == 3
        raise ZeroDivisionError
    assert os.listdir(tmp_path / "linesets") == []


def test_a_folder_of_its_own_where_none_is_set():
    from types import SimpleNamespace as Some

    def session(master, app):
        return Some(conf=Some(get=lambda name, default: default), sparkContext=Some(master=master, applicationId=app))

    own = _common.shared_dir(session("local[1]", "one"))
    assert os.path.isdir(own) and own == _common.shared_dir(session("local[1]", "one")) != _common.shared_dir(session("local[*]", "two"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _common.shared_dir(session("spark://host:7077", "three"))
