"""Byte fixtures: line splitting, carriage returns, codec, fields, partitions, plans, sinks and streams."""

import gzip
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linesets.cli import main
from linesets.functions import codec, extract, keys
from linesets.operators import frequency, order, partition, setops
from linesets.plans.removal import Removal
from linesets.plans.report import frequency_lines, parse_letters, two_places
from linesets.sources import lines as src
from linesets.sources import sinks
from linesets.streaming import pipelines


def put(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


def run(spark, tmp_path, plan, data, *removes):
    lines = src.read_lines(spark, [put(tmp_path, "in", data)])
    others = [src.read_lines(spark, [put(tmp_path, f"r{i}", r)]) for i, r in enumerate(removes)]
    return [bytes(r["line"]) for r in plan.run(lines, others).orderBy(*plan.order()).collect()]


def apply(spark, function, values):
    df = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "i int, v binary")
    got = [r["x"] for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]
    return [bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in got]


@pytest.mark.parametrize(
    "data,want",
    [
        (b"a\nb", [b"a", b"b"]),
        (b"a\n", [b"a"]),
        (b"", []),
        (b"\n\n", [b""]),
        (b"a\r\nb\r\na\n", [b"a", b"b"]),
        (b"ab\na\rb\n", [b"ab"]),
        (b"a\rb\nab\n", [b"a\rb"]),
        (b"a\r\r\na\n", [b"a\r", b"a"]),
        (b"\xff\xfe\n\0z\n", [b"\xff\xfe", b"\0z"]),
        (b"apple\nbanana\napple\ncherry\nbanana\ndate\n", [b"apple", b"banana", b"cherry", b"date"]),
    ],
)
def test_dedupe(spark, tmp_path, data, want):
    assert run(spark, tmp_path, Removal(), data) == want


INPUT, ONE, TWO = b"c\na\nb\na\nd\nc\n", b"a\n", b"a\nd\nz\n"


@pytest.mark.parametrize(
    "plan,removes,want",
    [
        (Removal(), (ONE, TWO), "cb"),
        (Removal(dedupe=False), (ONE, TWO), "cbc"),
        (Removal(keep_common=True), (ONE, TWO), "ad"),
        (Removal(keep_common=True, dedupe=False), (ONE, TWO), "aad"),
        (Removal(keep_common=True), (), ""),
        (Removal(sort=True), (), "abcd"),
        (Removal(), (b"a\nd",), "cb"),
    ],
)
def test_removal(spark, tmp_path, plan, removes, want):
    assert b"".join(run(spark, tmp_path, plan, INPUT, *removes)).decode() == want


def test_duplicates_and_metrics(spark, tmp_path):
    lines = src.read_lines(spark, [put(tmp_path, "in", INPUT)])
    removes = [src.read_lines(spark, [put(tmp_path, n, d)]) for n, d in (("x", ONE), ("y", TWO))]
    assert sorted(bytes(r["line"]) for r in Removal().duplicates(lines).collect()) == [b"a", b"c"]
    got = {r["metric"]: r["value"] for r in Removal().metrics(lines, removes).collect()}
    assert got == {"total": 6, "uniques": 4, "duplicates": 2, "list_1": 1, "list_2": 1}


def test_prefix(spark, tmp_path):
    data = b"abcz\nabca\nab\nabq\n"
    assert run(spark, tmp_path, Removal(prefix=3), data) == [b"abca", b"ab", b"abq"]
    assert run(spark, tmp_path, Removal(prefix=3), data, b"abcXXX\n") == [b"ab", b"abq"]


def test_merge(spark, tmp_path):
    assert run(spark, tmp_path, Removal(mode="merge"), b"a\nb\nb\nc\n", b"b\n") == [b"a", b"c"]
    assert run(spark, tmp_path, Removal(mode="merge", keep_common=True), b"a\nb\nb\nc\n", b"b\n") == [b"b"]
    with pytest.raises(ValueError, match="not sorted"):
        Removal(mode="merge").check(src.read_lines(spark, [put(tmp_path, "bad", b"b\na\n")]), [])


def test_codec(spark):
    plain = codec.ByteClass()
    encode = lambda v: codec.hex_encode(v, plain)
    values = [b"a:b", b"caf\xc3\xa9", b"plain~", b"\x7f", b"$HEX[61]", b""]
    assert apply(spark, encode, values) == [b"$HEX[613a62]", b"$HEX[636166c3a9]", b"plain~", b"$HEX[7f]", b"$HEX[61]", b""]
    assert apply(spark, lambda v: codec.hex_encode(v, plain.with_clear(":")), [b"a:b"]) == [b"a:b"]
    assert apply(spark, lambda v: codec.hex_encode(v, plain.with_set("a-b")), [b"abc"]) == [b"$HEX[616263]"]
    assert apply(spark, codec.hex_decode, [b"$HEX[616]", b"$HEX[6162", b"$HEX[zz]", b"$HEX[6A]x", b"x$HEX[61]"]) == [b"a", b"ab", b"", b"j", b"x$HEX[61]"]
    assert codec.parse_bytes("58,0x80-0xff,a") == {58, *range(128, 256), 97}


def test_every_byte(spark):
    got = apply(spark, codec.hex_encode, [bytes([b]) for b in range(256)])
    for b, x in enumerate(got):
        special = b <= 0x1F or b == 0x3A or b >= 0x7F
        assert x == (b"$HEX[%02x]" % b if special else bytes([b]))


def model_key(raw):
    out, i = bytearray(), 0
    while i < len(raw):
        if raw[i] == 13:
            i += 1
            if i == len(raw):
                break
        out.append(raw[i])
        i += 1
    return bytes(out)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.binary(max_size=12), min_size=1, max_size=60), st.lists(st.lists(st.sampled_from([97, 13, 255]), max_size=6).map(bytes), max_size=60))
def test_properties(spark, any_bytes, returns):
    values = [v.replace(b"\n", b"") for v in any_bytes + returns]
    assert apply(spark, keys.canonical_key, values) == [model_key(v) for v in values]
    assert apply(spark, keys.output_value, values) == [v[:-1] if v.endswith(b"\r") else v for v in values]
    plain = [v for v in values if not v.startswith(b"$HEX[")]
    assert apply(spark, lambda v: codec.hex_decode(codec.hex_encode(v)), plain) == plain
    once = apply(spark, codec.hex_encode, values)
    assert apply(spark, codec.hex_encode, once) == once


def test_fields(spark):
    assert apply(spark, extract.last_field, [b"h1:salt:pw", b"h1:", b":pw", b"nopw", b"a:b\r"]) == [b"pw", b"", None, None, b"b"]
    third = lambda v: extract.nth_field(v, 3)
    assert apply(spark, third, [b"a:b:", b"a:b"]) == [b"", None]
    assert apply(spark, lambda v: extract.nth_field(v, 2, "."), [b"a.b.c"]) == [b"b"]
    assert apply(spark, lambda v: extract.column_range(v, "3-9"), [b"abcdefghi", b"abcdefgh"]) == [b"cdefgh", None]
    assert apply(spark, lambda v: extract.column_range(v, "3-"), [b"abcde", b"ab"]) == [b"cde", None]
    assert apply(spark, lambda v: extract.column_range(v, "-2"), [b"abc", b"ab", b"a"]) == [b"ab", b"ab", None]
    assert extract.delimiter_byte("0x3a") == extract.delimiter_byte("58") == ":"


def test_text_columns(spark):
    df = spark.createDataFrame([(1, "a\nb\n"), (2, ""), (3, None), (4, "\n\n"), (5, "x")], "i int, t string")
    got = sorted(tuple(r) for r in src.explode_lines(df, "t", ["i"]).collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (4, 0, ""), (4, 1, ""), (5, 0, "x")]


def test_frequency(spark, tmp_path):
    lines = src.read_lines(spark, [put(tmp_path, "in", b"password\n123456\npassword\npassword\n123456\nabc\n")])
    freq = Removal().frequency(lines)
    assert list(frequency_lines(freq, parse_letters("clw")[0])) == [b"Count\tLength\tLine", b"3\t8\tpassword", b"2\t6\t123456", b"1\t3\tabc"]
    rows = list(frequency_lines(freq, ["s"]))
    assert rows[1:] == [b"50.00\t50.00", b"33.33\t83.33", b"16.67\t100.00"]
    hist = frequency.length_histogram(freq.select("line")).orderBy("len").collect()
    assert [(r["len"], r["cnt"], two_places(r["cumul"])) for r in hist] == [(3, 1, "33.33"), (6, 1, "66.67"), (8, 1, "100.00")]
    assert (two_places(0.125), two_places(2.675)) == ("0.12", "2.67")
    assert parse_letters("a") == (["c", "l", "w"], True)
    with pytest.raises(ValueError):
        parse_letters("z")


def test_partition(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "cd"), (4, "\x80")], "seq int, line string").withColumn("line", F.encode("line", "ISO-8859-1"))
    split = partition.split_by_length(df, "x#.txt")
    written = {r["file"]: r["n"] for r in sinks.write_split(split, str(tmp_path / "out"), ["seq"]).collect()}
    assert written == {"x_02.txt": 2, "x_03.txt": 1, "x_08.txt": 1}
    assert (tmp_path / "out" / "x_02.txt").read_bytes() == b"ab\ncd\n"
    assert (tmp_path / "out" / "x_08.txt").read_bytes() == b"$HEX[80]\n"
    sinks.write_split(split, str(tmp_path / "out"), ["seq"])
    assert (tmp_path / "out" / "x_03.txt").read_bytes() == b"abc\nabc\n"
    by_length = order.sort_by_length(df.limit(3), F.octet_length("line"), ["seq"]).collect()
    assert [bytes(r["line"]) for r in by_length] == [b"ab", b"cd", b"abc"]


def test_sources(spark, tmp_path):
    plain = put(tmp_path, "a.lst", b"one\ntwo\n")
    zipped = put(tmp_path, "b.lst", gzip.compress(b"three\r\nfour"))
    named = put(tmp_path, "c.gz", gzip.compress(b"five\n"))
    rows = src.read_lines(spark, [plain, zipped, named]).orderBy(*src.ORDER).collect()
    assert [(r["file_idx"], bytes(r["raw"])) for r in rows] == [(1, b"one"), (1, b"two"), (2, b"three\r"), (2, b"four"), (3, b"five")]
    os.mkdir(tmp_path / "folder")
    found, said = src.resolve(spark, [plain, str(tmp_path / "folder"), str(tmp_path / "none")], ignore_missing=True, skip=plain)
    assert found == [] and len(said) == 3
    with pytest.raises(FileNotFoundError):
        src.resolve(spark, [str(tmp_path / "none")])
    for name in ("x.txt", "x.orig", "x.MD5"):
        put(tmp_path, name, b"")
    assert [os.path.basename(p) for p in src.select_paths(spark, [str(tmp_path / "x.txt")])] == ["x.MD5"]
    assert src.select_paths(spark, ["y.orig", "y.z"]) == ["y.z"]
    assert src.select_paths(spark, ["y.orig"], None) == ["y.orig"]
    assert src.read_exclusions(".a\n.b\n") == (".a", ".b")
    assert (src.parse_size("4k"), src.parse_size("1g"), src.parse_size("7")) == (4096, 1 << 30, 7)


def test_cli(spark, tmp_path, capfdbinary):
    source, other, out, dup = put(tmp_path, "in", INPUT), put(tmp_path, "other", TWO), str(tmp_path / "out"), str(tmp_path / "dup")
    main(["remove", "-D", dup, source, out, other])
    assert open(out, "rb").read() == b"c\nb\n"
    assert sorted(open(dup, "rb").read()) == sorted(b"a\nc\n")
    main(["remove", "-s", source, source])
    assert open(source, "rb").read() == b"a\nb\nc\nd\n"
    main(["rehex", "-U", ":", put(tmp_path, "h", b"a:b\n\xff\n")])
    main(["extract", "-f", "2", put(tmp_path, "e.lst", b"a:b:c\n")])
    main(["dedupe", source, source])
    assert capfdbinary.readouterr().out == b"a:b\n$HEX[ff]\nb\na\nb\nc\nd\n"


def test_invariants(spark, tmp_path):
    lines = src.read_lines(spark, [put(tmp_path, "in", b"".join(b"%d\n" % (i * i % 97) for i in range(500)))])
    other = [src.read_lines(spark, [put(tmp_path, "r", b"".join(b"%d\n" % i for i in range(0, 97, 3)))])]
    got = {m: {bytes(r["line"]) for r in Removal(mode=m).run(lines, other).collect()} for m in ("hash", "search", "file", "merge")}
    assert len(set(map(frozenset, got.values()))) == 1
    both = {bytes(r["line"]) for r in Removal(keep_common=True).run(lines, other).collect()}
    every = {bytes(r["line"]) for r in Removal().run(lines, []).collect()}
    assert got["hash"] | both == every and not got["hash"] & both
    stats = setops.counts(Removal().keyed(lines), "key").first()
    assert (stats["total"], stats["uniques"], stats["duplicates"]) == (500, len(every), 500 - len(every))
    again = {bytes(r["line"]) for r in Removal().run(lines.repartition(7), other).collect()}
    assert again == got["hash"]


def test_stream(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    for batch in (b"a\nb:\na\n", b"b:\nc\n"):
        put(tmp_path / "in", f"f{len(os.listdir(tmp_path / 'in'))}", batch)
        lines = pipelines.deduped(pipelines.read_stream(spark, str(tmp_path / "in")))
        pipelines.write_stream(lines, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(got) == ["$HEX[623a]", "a", "c"]
