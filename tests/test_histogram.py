"""hist_len counts lines of any length, as its SQL does."""

from linesets import queries
from linesets.operators import frequency


def test_a_line_of_a_million_bytes(spark, monkeypatch):
    lines = spark.createDataFrame([("a" * 1_000_000,), ("bc",), ("bc",), ("de",)], "line string")
    monkeypatch.setattr(queries, "doc_lines", lambda spark, d: lines)
    found = [tuple(r)[:2] for r in queries.hist_len(spark, "").orderBy("len").collect()]
    assert found == [(2, 2), (1_000_000, 1)]
    assert frequency.length_histogram(lines).count() == 0  # the report's switch
