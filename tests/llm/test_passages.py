"""Passages that repeat from the middle of a line, against a brute-force version."""

import random
import re

import pytest

from linesets.llm import passages, queries

SF = "/root/testdata/sf0.001"


def brute_passages(texts, window):
    """Every window of words compared with all earlier ones."""
    first, out = {}, {}
    for d in sorted(texts):
        words = re.findall(r"[^ \t-\r]+", texts[d])
        pieces = re.findall(r"[^ \t-\r]+[ \t-\r]*", texts[d])
        cut = set()
        for i in range(len(words) - window + 1):
            if first.setdefault(tuple(words[i : i + window]), (d, i)) != (d, i):
                cut |= set(range(i, i + window))
        lead = re.match(r"[ \t-\r]*", texts[d])[0]
        out[d] = (lead + "".join(p for i, p in enumerate(pieces) if i not in cut) if cut else texts[d], len(cut))
    return out


def cut(spark, texts, **settings):
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    return {r["doc_id"]: (r["text"], r[passages.N_WORDS_CUT]) for r in passages.cut_passages(df, **settings).collect()}


def test_spliced_mid_line(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    fresh = lambda k: " ".join(f"{k}{i}" for i in range(20))
    texts = {1: f"{fresh('a')} {passage} {fresh('b')}", 2: f"{fresh('c')}\n {fresh('d')} {passage.replace(' ', '\n', 2)}  {fresh('e')}", 3: fresh("f")}
    assert cut(spark, texts) == {1: (texts[1], 0), 2: (f"{fresh('c')}\n {fresh('d')} {fresh('e')}", 55), 3: (texts[3], 0)}


def test_short_and_odd_texts(spark):
    texts = {1: "x " * 49, 2: "x " * 49, 3: " \n\t", 4: "", 5: None, 6: "\n y" + " y" * 70, 7: " ".join(map(str, range(10))) * 1}
    found = cut(spark, texts)
    assert found == {1: (texts[1], 0), 2: (texts[2], 0), 3: (texts[3], 0), 4: ("", 0), 5: (None, 0), 6: ("\n y ", 70), 7: (texts[7], 0)}


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (5, text), (None, text), (None, text), (9, "q " + text)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted(str((r["doc_id"], r["text"])) for r in passages.cut_passages(df).collect())
    assert found == sorted(str(r) for r in [(5, ""), (5, ""), (None, text), (None, text), (9, "q ")])


@pytest.mark.parametrize(("window", "gram", "letters"), [(6, 2, "abc"), (9, 4, "ab"), (5, 8, "abcdef"), (4, 1, "ab")])
def test_brute_force(spark, window, gram, letters):
    rng = random.Random(window)
    texts = {d: rng.choice(["", "\n "]) + "".join(rng.choice(letters) + rng.choice([" ", "\n", " \t"]) for _ in range(rng.randrange(40))) for d in range(150)}
    texts |= {200 + d: "a b " * rng.randrange(20) for d in range(5)}
    assert cut(spark, texts, window=window, gram=gram) == brute_passages(texts, window)


def test_query(spark):
    lines = {r["doc_id"]: r for r in queries.QUERIES["op7_line_dedup"](spark, SF).collect()}
    want = brute_passages({d: r["kept_text"] or "" for d, r in lines.items()}, passages.WINDOW)
    found = {r["doc_id"]: r for r in queries.QUERIES["op7_passage_dedup"](spark, SF).collect()}
    assert {d: (r["kept_text"] or "", r["n_words_cut"]) for d, r in found.items()} == want
    assert {d: (r["n_lines"], r["n_cut"]) for d, r in found.items()} == {d: (r["n_lines"], r["n_cut"]) for d, r in lines.items()}
    assert sum(n > 0 for _, n in want.values()) > 5
