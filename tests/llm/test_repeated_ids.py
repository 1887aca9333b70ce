"""n-gram join where doc_ids repeat with other texts or are null."""

import random

from linesets.llm import ngram_join
from tests.llm.test_edges import near_copies

SCHEMA = "doc_id bigint, text string"


def components(spark, rows):
    return sorted(map(str, ((r["doc_id"], r["component_id"]) for r in ngram_join.classes(spark.createDataFrame(rows, SCHEMA)).collect())))


def test_a_doc_id_with_two_texts(spark):
    rng = random.Random(5)
    a, b, c = (near_copies(3, rng, changed=1) for _ in range(3))
    rows = [(1, a[0]), (1, b[0]), (2, a[1]), (3, b[1]), (4, c[0]), (5, c[1]), (5, b[2]), (6, c[2]), (7, "other words that stand alone here")]
    want = [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (5, 1), (6, 1), (7, 7)]
    assert components(spark, rows) == sorted(map(str, want))


def test_null_ids_link(spark):
    rng = random.Random(6)
    a, b = near_copies(3, rng, changed=1), near_copies(3, rng, changed=1)
    far = [" ".join(f"v{i}" for i in range(n)) for n in (180, 200, 240)]  # the first and last are no link
    rows = [(None, a[0]), (None, a[1]), (None, b[0]), (9, b[1]), (4, b[2]), (20, far[0]), (None, far[1]), (21, far[2])]
    want = [(None, None), (None, None), (None, 4), (9, 4), (4, 4), (20, 20), (None, 20), (21, 20)]
    assert components(spark, rows) == sorted(map(str, want))


def test_pipeline_keeps_one_of_null_ids(spark):
    import corpus_pipeline

    rng = random.Random(7)
    a, b = near_copies(3, rng, changed=1), near_copies(2, rng, changed=1)
    rows = [(None, a[0], "x"), (None, a[1], "y"), (None, a[1], "z"), (None, b[0], "x"), (9, b[1], "x"), (None, "", "x"), (None, "", "y"), (None, None, "x")]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, f"{SCHEMA}, source string"), "").collect()
    assert sorted((r["text"] or "", r["source"]) for r in kept if r["text"] not in a) == sorted([(b[1], "x"), ("", "x"), ("", "y"), ("", "x")])
    assert sum(r["text"] in a for r in kept) == 1
