"""Byte fixtures of plans and the command line: prefixes, figures, report order, standard input, parts, splits."""

import gzip
import io
import os

import pytest
from pyspark.sql import functions as F

from linesets.cli import main
from linesets.operators import order
from linesets.plans.removal import Removal
from linesets.plans.report import frequency_lines
from linesets.sources import lines as src


def put(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


def read(spark, tmp_path, *files):
    return [src.read_lines(spark, [put(tmp_path, f"f{i}", d)]) for i, d in enumerate(files)]


def shown(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_prefix_duplicates_and_figures(spark, tmp_path):
    lines, one, two = read(spark, tmp_path, b"abcz\nabca\nab\nabq\nabcb\n", b"abcXXX\nq\n", b"abc\nabq\nab\n")
    plan = Removal(prefix=3)
    assert sorted(bytes(r["line"]) for r in plan.duplicates(lines).collect()) == [b"abcb", b"abcz"]
    assert shown(plan.figures(lines, [one, two])) == {"total": 5, "uniques": 3, "duplicates": 2, "list_1": 1, "list_2": 2, "matched": 3, "written": 0}
    assert {r["file_idx"]: r["matched"] for r in plan.matches(lines, [one, two]).collect()} == {1: 1, 2: 2}
    every = Removal(prefix=3, dedupe=False)
    assert shown(every.figures(lines, [one])) == {"total": 5, "uniques": 3, "duplicates": 2, "list_1": 3, "matched": 3, "written": 2}
    assert every.duplicates(lines).count() == 0


def test_figures(spark, tmp_path):
    lines, one, two = read(spark, tmp_path, b"c\na\nb\na\nd\nc\n", b"a\n", b"a\nd\nz\n")
    base = {"total": 6, "uniques": 4, "duplicates": 2, "list_1": 1, "list_2": 1, "matched": 2}
    assert shown(Removal().figures(lines, [one, two])) == base | {"written": 2}
    assert shown(Removal(keep_common=True).figures(lines, [one, two])) == base | {"written": 2}
    assert shown(Removal(dedupe=False).figures(lines, [one, two])) == base | {"list_1": 2, "matched": 3, "written": 3}
    assert shown(Removal().figures(lines, [])) == {"total": 6, "uniques": 4, "duplicates": 2, "matched": 0, "written": 4}
    (empty,) = read(spark, tmp_path, b"")
    assert shown(Removal().figures(empty, [])) == {"total": 0, "uniques": 0, "duplicates": 0, "matched": 0, "written": 0}


def test_report_follows_identities(spark, tmp_path):
    """A line with a carriage return inside stands where its identity sorts, not where its bytes do."""
    (lines,) = read(spark, tmp_path, b"a\rz\nab\nax\n")
    assert list(frequency_lines(Removal().frequency(lines), ["w"])) == [b"Line", b"ab", b"ax", b"a\rz"]
    assert list(frequency_lines(Removal().frequency(lines), ["s"]))[1:] == [b"33.33\t33.33", b"33.33\t66.67", b"33.33\t100.00"]


class Stdin:
    def __init__(self, data):
        self.buffer = io.BytesIO(data)


def left(spark):
    folder = src._scratch(spark).removeprefix("file:")
    return [n for n in os.listdir(folder) if n.startswith(("stdin-", "unzip-"))]


def test_standard_input(spark, tmp_path, monkeypatch, capfdbinary):
    before = left(spark)
    source = put(tmp_path, "in", b"a\nb\nc\nb\n")
    monkeypatch.setattr("sys.stdin", Stdin(b"b\n"))
    main(["remove", source, "stdout", "stdin"])
    monkeypatch.setattr("sys.stdin", Stdin(gzip.compress(b"x\nx\ny\n")))
    main(["dedupe"])
    monkeypatch.setattr("sys.stdin", Stdin(b"c\nq\n"))
    main(["remove", "stdin", "stdout", source, "stdin"])  # the list that is the input is skipped
    assert capfdbinary.readouterr().out == b"a\nc\nx\ny\nq\n"
    assert left(spark) == before


def test_report_of_the_command_line(spark, tmp_path):
    source, other, out = put(tmp_path, "in", b"a\nbb\na\n"), put(tmp_path, "other", b"a\n"), str(tmp_path / "report")
    main(["remove", "-q", "a", source, out, other])
    text = open(out, "rb").read().split(b"\n")
    assert text[:3] == [b"Count\tLength\tLine", b"2\t1\ta", b"1\t2\tbb"]
    assert text[3:6] == [b"", b"", b""]
    assert text[-1] == b"" and len(text) == 10


def test_split_sorted_takes_in_what_is_there(spark, tmp_path, capfd):
    source = put(tmp_path, "in", b"abc\nab\ncd\n")
    put(tmp_path, "out_02", b"zz\n")
    put(tmp_path, "out_07", b"other\n")
    main(["split", "-s", "-o", str(tmp_path / "out"), source])
    assert (tmp_path / "out").read_bytes() == b"zz\nab\ncd\nabc\n"
    assert not (tmp_path / "out_02").exists() and (tmp_path / "out_07").exists()
    said = capfd.readouterr().err
    assert "2 lines written to out_02" in said and "1 lines written to out_03" in said


def test_parts(spark, tmp_path):
    source = put(tmp_path, "in", b"".join(b"%d:x\n" % (i % 50) for i in range(500)))
    lines = lambda folder: [x for p in sorted(os.listdir(folder)) if p.startswith("part-") for x in (tmp_path / folder / p).read_bytes().splitlines()]
    main(["rehex", "--any-order", "--parts", str(tmp_path / "coded"), source])
    assert sorted(lines(tmp_path / "coded")) == sorted(b"$HEX[%s]" % (b"%d:x" % (i % 50)).hex().encode() for i in range(500))
    main(["dedupe", "-U", ":", "--parts", str(tmp_path / "first"), source])
    assert lines(tmp_path / "first") == [b"%d:x" % i for i in range(50)]
    main(["remove", "--parts", source, str(tmp_path / "kept"), put(tmp_path, "some", b"3:x\n")])
    assert lines(tmp_path / "kept") == [b"%d:x" % i for i in range(50) if i != 3]


def test_many_files_in_one_scan(spark, tmp_path):
    names = [put(tmp_path, f"list{i:02}", (gzip.compress if i % 3 == 0 else bytes)(b"%d\nsame\n" % i)) for i in range(12)]
    found = src.read_lines(spark, [*names, names[1]])
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    rows = sorted((r["file_idx"], r["seq"], bytes(r["raw"])) for r in found.collect())
    assert [(i, x) for i, _, x in rows] == [(i + 1, x) for i in [*range(12), 12] for x in (b"%d" % (i % 12 if i < 12 else 1), b"same")]
    src.delete_staged(spark)


def test_sortedness_of_splits(spark, tmp_path):
    for data, bad in ((b"a\nb\nb\nc\n", None), (b"a\nc\nb\nd\na\n", (b"c", b"b")), (b"", None)):
        (lines,) = read(spark, tmp_path, data)
        found = [(bytes(r["prev"]), bytes(r["line"])) for r in order.unsorted_lines(lines, "raw").collect()]
        assert found == ([bad] if bad else [])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        numbers = [b"%06d" % i for i in range(5000)]
        (lines,) = read(spark, tmp_path, b"\n".join(numbers))
        assert lines.select("block").distinct().count() > 3
        assert order.unsorted_lines(lines, "raw").count() == 0
        cut = lines.groupBy("block").agg(F.count(F.lit(1)).alias("n")).orderBy("block").first()["n"]
        numbers[cut - 1], numbers[cut] = numbers[cut], numbers[cut - 1]  # the border of two splits
        (lines,) = read(spark, tmp_path, b"\n".join(numbers))
        assert [(bytes(r["prev"]), bytes(r["line"])) for r in order.unsorted_lines(lines, "raw").collect()] == [(numbers[cut - 1], numbers[cut])]
        with pytest.raises(ValueError, match="not sorted"):
            Removal(mode="merge").check(lines, [])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ordinals_of_skewed_keys(spark, monkeypatch):
    """A common beginning or length doesn't put all rows into one slice."""
    df = spark.range(20_000).select(F.concat(F.lit("http://example.org/"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("line"), "id", F.lit(25).alias("len"))
    for few in (32, 3):  # compared with each border, and by halving
        monkeypatch.setattr(order, "FEW", few)
        for by in (order.by_bytes(), order.by_length(F.col("len"), ["id"])):
            sizes = [r["count"] for r in df.groupBy(order.slices(df, by)(df).alias("s")).count().collect()]
            assert len(sizes) == 8 and max(sizes) < 20_000 / 4
            assert [r["ord"] for r in order.with_ordinal(df, by).orderBy("id").collect()] == list(range(1, 20_001))
            ranked = order.rank_within(df.withColumn("g", F.col("id") % 3), "g", by).orderBy("id").collect()
            assert [r["_rank"] for r in ranked] == [i // 3 + 1 for i in range(20_000)]
    assert order.with_ordinal(df.limit(0), order.by_bytes()).collect() == []
