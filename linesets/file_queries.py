"""Queries that go through the engine's plans, files and sinks, with DuckDB SQL over the same tables.

Files are written to the shared folder first; what they hold comes from the tables.
"""

from __future__ import annotations

import io
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesets.operators import order as ordering
from linesets.operators.frequency import length_histogram
from linesets.operators.partition import split_by_length
from linesets.plans.removal import Removal
from linesets.plans.report import parse_letters
from linesets.queries import ORDER, L, doc_lines, table, text
from linesets.sources import lines as src
from linesets.sources import sinks
from linesets.sources.lines import explode_lines
from linesets.streaming import pipelines

N = 8


def raw_lines(lines: DataFrame, first: str, second: str) -> DataFrame:
    """Lines of a table in the form of a file's."""
    place = F.lit(1).alias("file_idx"), F.col(first).cast("bigint").alias("block"), F.col(second).cast("bigint").alias("seq")
    return lines.select(*place, F.col("line").cast("binary").alias("raw"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return raw_lines(doc_lines(spark, d), *ORDER)


def benchmark(spark: SparkSession, d: str) -> DataFrame:
    return raw_lines(explode_lines(table(spark, d, "benchmark"), "text", ["item_id"]), "item_id", "pos")


def both_lists(spark: SparkSession, d: str) -> list[DataFrame]:
    turns = explode_lines(table(spark, d, "conversations"), "text", ["conv_id", "turn"])
    return [benchmark(spark, d), raw_lines(turns, "conv_id", "turn")]


def _shown(kept: DataFrame) -> DataFrame:
    return kept.select(F.col("block").alias("id"), F.col("seq").alias("pos"), text("line"))


def _place(spark: SparkSession, name: str) -> str:
    return f"{src._scratch(spark).rstrip('/')}/linesets-files/{uuid.uuid4().hex}/{name}"


# plans -------------------------------------------------------------------------------------


def plan_search(spark, d):
    return _shown(Removal(mode="search").run(documents(spark, d), both_lists(spark, d)))


def plan_out_of_core(spark, d):
    return _shown(Removal(mode="file", keep_common=True, dedupe=False).run(documents(spark, d), both_lists(spark, d)))


def plan_figures(spark, d):
    return Removal().figures(documents(spark, d), both_lists(spark, d))


def prefix_duplicates(spark, d):
    return _shown(Removal(prefix=N).duplicates(documents(spark, d)))


def prefix_figures(spark, d):
    return Removal(prefix=4).figures(documents(spark, d), both_lists(spark, d))


def prefix_matches(spark, d):
    return Removal(prefix=4).matches(documents(spark, d), both_lists(spark, d))


def report_all(spark, d):
    """The rows of the report that the letter for all asks for."""
    columns, histogram = parse_letters("a")
    frequency = Removal().frequency(documents(spark, d))
    names = {"c": F.col("cnt"), "l": F.col("len"), "w": text("line")}
    rows = frequency.select(F.lit("line").alias("kind"), *[names[c] for c in columns])
    lengths = length_histogram(frequency.select("line"), max_length=None).select(F.lit("length").alias("kind"), "cnt", "len", F.lit(None).cast("string").alias("line"))
    return rows.unionByName(lengths) if histogram else rows


# files -------------------------------------------------------------------------------------


def _lines(df: DataFrame) -> DataFrame:
    return df.select(*src.ORDER, F.decode("raw", "UTF-8").alias("line"))


def file_lines(spark, d):
    """All lines written in parallel, and read back from many files by one scan."""
    folder = _place(spark, "parts")
    sinks.write_lines(doc_lines(spark, d), folder, ORDER, single=False)
    found, _ = src.resolve(spark, [f"{folder}/part-*"])
    return _lines(src.read_lines(spark, found)).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def file_order(spark, d):
    """One ordered file, and its lines numbered."""
    target = _place(spark, "lines")
    sinks.write_lines(doc_lines(spark, d), target, ORDER)
    return ordering.with_ordinal(_lines(src.read_lines(spark, [target])), ordering.by_place(src.ORDER)).select("ord", "line")


def file_gzip(spark, d):
    """Gzip data under names that don't say so."""
    folder = _place(spark, "zipped")
    values = benchmark(spark, d).select(F.col("raw").cast("string").alias("value"))
    values.repartition(2).write.option("compression", "gzip").text(folder)
    names = []
    for part in sinks._part_files(spark, folder):
        fs, target = src._fs(spark, f"{folder}/list{len(names)}")
        fs.rename(part, target)
        names.append(target.toString())
    return _lines(src.read_lines(spark, names)).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def file_stdin(spark, d):
    """A byte stream as a source: the names of the nations."""
    names = [r["n_name"] for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    path = src.spool_stdin(spark, io.BytesIO("".join(f"{n}\n" for n in names).encode()))
    return ordering.with_ordinal(_lines(src.read_lines(spark, [path])), ordering.by_place(src.ORDER)).select("ord", "line")


def file_in_place(spark, d):
    """Dedup of a file into itself, and its duplicates beside it."""
    target, beside = _place(spark, "list"), _place(spark, "duplicates")
    sinks.write_lines(benchmark(spark, d).union(benchmark(spark, d)), target, src.ORDER, "raw")
    plan, lines = Removal(), src.read_lines(spark, [target])
    sinks.write_lines(plan.duplicates(lines), beside, src.ORDER)
    sinks.write_lines(plan.run(lines, []), target, plan.order())
    return _lines(src.read_lines(spark, [target, beside])).groupBy("file_idx", "line").agg(F.count(F.lit(1)).alias("n"))


def file_select(spark, d):
    """Globs, folders, missing files, the input itself, endings that are left out, and x.txt for the other x.*."""
    folder = _place(spark, "some")
    rows = table(spark, d, "nation").collect()  # 25 rows
    names = {f"n{r['n_nationkey']}{end}": r["n_name"] for r in rows for end in ((".txt", ".MD5") if r["n_nationkey"] % 5 == 0 else (".orig",) if r["n_nationkey"] % 5 == 1 else (".lst",))}
    for name, line in names.items():
        fs, path = src._fs(spark, f"{folder}/{name}")
        out = fs.create(path, True)
        out.write(bytearray(f"{line}\n".encode()))
        out.close()
    fs.mkdirs(src._fs(spark, f"{folder}/n99.lst")[1])
    asked = [f"{folder}/{n}" for n in sorted(names) if not n.endswith((".MD5", ".lst"))] + [f"{folder}/*.lst", f"{folder}/none", f"{folder}/n2.lst"]
    found, said = src.resolve(spark, src.select_paths(spark, asked), ignore_missing=True, skip=f"{folder}/n2.lst")
    assert len(said) == 3  # a folder, a file that isn't there, and the input
    return _lines(src.read_lines(spark, found)).select("line")


def file_split(spark, d):
    """One file for each length, written twice, and what the names and lines of the second time give."""
    folder = _place(spark, "split")
    split = split_by_length(benchmark(spark, d).withColumnRenamed("raw", "line"), "out")
    sinks.write_split(split, folder, src.ORDER)
    return sinks.write_split(split, folder, src.ORDER)


def file_by_length(spark, d):
    """One file of lines by length, after files of these lengths were there."""
    folder = _place(spark, "split")
    target = _place(spark, "sorted")
    split = split_by_length(benchmark(spark, d).withColumnRenamed("raw", "line"), "out")
    sinks.write_split(split, folder, src.ORDER)
    sinks.write_by_length(split, folder, target, src.ORDER)
    return ordering.with_ordinal(_lines(src.read_lines(spark, [target])), ordering.by_place(src.ORDER)).select("ord", "line")


def stream_dedupe(spark, d):
    """First arrivals of encoded lines, as files arrive."""
    arrived, folder, state = (_place(spark, n) for n in ("in", "out", "state"))
    sinks.write_lines(benchmark(spark, d).union(benchmark(spark, d)), arrived, [], "raw", single=False)
    pipelines.write_stream(pipelines.deduped(pipelines.read_stream(spark, arrived)), folder, state).awaitTermination()
    return spark.read.text(folder).select(F.col("value").alias("line"))


H = "hex(encode(line))"
CODED = f"case when regexp_matches(line, '[\\x00-\\x1f:\\x7f]') or octet_length(encode(line)) <> length(line) then '$HEX[' || lower({H}) || ']' else line end"
P = f"""p4 as (select *, row_number() over (partition by substr({H}, 1, 8) order by line, id, pos) k from l),
p8 as (select *, row_number() over (partition by substr({H}, 1, 16) order by line, id, pos) k from l),
r4 as (select substr({H}, 1, 8) as px, min(f) as f from r group by 1),
m4 as (select p4.*, r4.f from p4 left join r4 on substr(hex(encode(p4.line)), 1, 8) = r4.px),
bl as (select line, item_id, pos from b),
nn as (select n_nationkey as k, n_name as line from nation)
"""


def _figures(rows: str, first: str, hit: str) -> str:
    return f"""select 'total' as metric, count(*) as value from {rows} union all select 'uniques', count(*) from {rows} where {first}
    union all select 'duplicates', count(*) from {rows} where not {first} union all select 'matched', count(*) from {rows} where {first} and {hit}
    union all select 'written', count(*) from {rows} where {first} and not {hit}"""


ORACLE = {
    "plan_search": "select * from d where line not in (select line from r)",
    "plan_out_of_core": "select id, pos, line from l where line in (select line from r)",
    "plan_figures": _figures("rk", "rn = 1", "line in (select line from r)")
    + " union all select 'list_' || f, count(*) from d join (select line, min(f) f from r group by line) using (line) group by f",
    "prefix_duplicates": "select id, pos, line from p8 where k > 1",
    "prefix_figures": _figures("m4", "k = 1", "f is not null") + " union all select 'list_' || f, count(*) from m4 where k = 1 and f is not null group by f",
    "prefix_matches": "select f::int as file_idx, count(*) as matched from m4 where k = 1 and f is not null group by f",
    "report_all": """select 'line' as kind, count(*) as cnt, octet_length(encode(line))::bigint as len, line from l group by line
        union all select 'length', count(*), octet_length(encode(line))::bigint as n, null from d group by n""",
    "file_lines": "select line, count(*) as n from l group by line",
    "file_order": "select row_number() over (order by id, pos) as ord, line from l",
    "file_gzip": "select line, count(*) as n from bl group by line",
    "file_stdin": "select row_number() over (order by k) as ord, line from nn",
    "file_in_place": """select 1 as file_idx, line, 1::bigint as n from bl group by line union all select 2, line, 2 * count(*) - 1 from bl group by line""",
    # the .lst files but for the input, and the other files of x.txt
    "file_select": "select line from nn where k % 5 <> 1",
    "file_split": f"""select 'out_' || case when n < 100 then lpad(n::varchar, 2, '0') else n::varchar end as file, count(*) as n
        from (select octet_length(encode({CODED})) as n from bl) group by 1""",
    "file_by_length": f"""select row_number() over (order by octet_length(encode(coded)), again, item_id, pos) as ord, coded as line
        from (select {CODED} as coded, item_id, pos, unnest([1, 2]) as again from bl)""",
    "stream_dedupe": f"select distinct {CODED} as line from bl",
}

QUERIES = {name: globals()[name] for name in ORACLE}
ORACLE = {name: L.rstrip() + ",\n" + P + sql for name, sql in ORACLE.items()}
