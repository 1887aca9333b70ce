"""Catalogue of the engine's queries over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesets.functions import codec, extract
from linesets.functions.keys import byte_length, canonical_key, output_value, prefix_key, with_commas
from linesets.operators import frequency as freq
from linesets.operators import order as ordering
from linesets.operators import partition, setops
from linesets.sources.lines import EXCLUDED, explode_lines, spread

ORDER = ["id", "pos"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return explode_lines(spread(table(spark, d, "documents").select("doc_id", "text")), "text", ["doc_id"]).withColumnRenamed("doc_id", "id")


def lists(spark: SparkSession, d: str) -> DataFrame:
    one = explode_lines(table(spark, d, "benchmark"), "text", ["item_id"]).select("line")
    two = explode_lines(table(spark, d, "conversations"), "text", ["conv_id"]).select("line")
    return setops.union_removes(one, two)


def binary_lines(spark: SparkSession, d: str) -> DataFrame:
    return doc_lines(spark, d).withColumn("line", F.col("line").cast("binary"))


def text(name: str):
    return F.decode(F.col(name), "UTF-8").alias(name)


def scan_lines(spark, d):
    return doc_lines(spark, d)


def dedupe_first(spark, d):
    return setops.dedupe_first(doc_lines(spark, d), ORDER)


def dedupe_duplicates(spark, d):
    return setops.duplicates(doc_lines(spark, d), ORDER)


def dedupe_stats(spark, d):
    return setops.counts(doc_lines(spark, d))


def remove_dedupe(spark, d):
    return setops.remove(setops.dedupe_first(doc_lines(spark, d), ORDER), lists(spark, d)).select(*ORDER, "line")


def remove_keep_dups(spark, d):
    return setops.remove(doc_lines(spark, d), lists(spark, d)).select(*ORDER, "line")


def remove_merge(spark, d):
    return setops.remove(setops.dedupe_first(doc_lines(spark, d), ORDER), lists(spark, d), how="merge").select(*ORDER, "line")


def common_dedupe(spark, d):
    return setops.common(setops.dedupe_first(doc_lines(spark, d), ORDER), lists(spark, d)).select(*ORDER, "line")


def common_keep_dups(spark, d):
    return setops.common(doc_lines(spark, d), lists(spark, d)).select(*ORDER, "line")


def remove_attribution(spark, d):
    return setops.attribution(setops.dedupe_first(doc_lines(spark, d), ORDER), lists(spark, d))


def match_counts(spark, d):
    return freq.match_counts(doc_lines(spark, d), lists(spark, d))


def remove_union(spark, d):
    return lists(spark, d).select("line").distinct()


def sort_bytes(spark, d):
    every = doc_lines(spark, d)
    return ordering.with_ordinal(setops.dedupe_first(every, ORDER).select("line"), ordering.by_bytes(), like=every)


def restore_order(spark, d):
    every = doc_lines(spark, d)
    return ordering.with_ordinal(setops.dedupe_first(every, ORDER), ordering.by_place(ORDER), like=every).select("id", "pos", "ord")


def prefix_dedupe(spark, d):
    return setops.dedupe_prefix(binary_lines(spark, d), 8, ORDER).select(*ORDER, text("line"))


def prefix_remove(spark, d):
    return setops.remove_prefix(binary_lines(spark, d), lists(spark, d), 4).select(*ORDER, text("line"))


def prefix_common(spark, d):
    return setops.common_prefix(binary_lines(spark, d), lists(spark, d), 4).select(*ORDER, text("line"))


def freq_count_len_line(spark, d):
    return freq.frequency(doc_lines(spark, d))


def freq_running(spark, d):
    lines = doc_lines(spark, d)
    return freq.running(freq.frequency(lines), like=lines)


def hist_len(spark, d):
    return freq.length_histogram(doc_lines(spark, d), max_length=None)


def len_minmax(spark, d):
    return freq.length_bounds(doc_lines(spark, d))


def canonical_lines(spark, d):
    lines = binary_lines(spark, d)
    return lines.select(*ORDER, F.hex(canonical_key(F.col("line"))).alias("key_hex"), F.hex(output_value(F.col("line"))).alias("value_hex"))


def key_prefix(spark, d):
    return binary_lines(spark, d).select(*ORDER, F.hex(prefix_key(F.col("line"), 5)).alias("prefix_hex"))


def rehex(spark, d):
    return doc_lines(spark, d).select(*ORDER, F.decode(codec.hex_encode(F.col("line")), "UTF-8").alias("coded"))


def rehex_classes(spark, d):
    classed = codec.ByteClass().with_clear("0x80-0xff").with_set("x-z,44")
    return doc_lines(spark, d).select(*ORDER, F.decode(codec.hex_encode(F.col("line"), classed), "UTF-8").alias("coded"))


def unhex_roundtrip(spark, d):
    back = codec.hex_decode(codec.hex_encode(F.col("line")))
    return doc_lines(spark, d).select(*ORDER, F.decode(back, "UTF-8").alias("line"))


def recoded_length(spark, d):
    return doc_lines(spark, d).select(*ORDER, codec.recoded_length(F.col("line")).alias("len"))


def field_last(spark, d):
    events = table(spark, d, "events").select("event_id", F.col("props").alias("line"))
    return events.select("event_id", F.decode(extract.last_field(F.col("line")), "UTF-8").alias("field")).filter("field is not null")


def field_nth(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id", F.decode(extract.nth_field(F.col("url"), 4, "/"), "UTF-8").alias("field")).filter("field is not null")


def field_last_coded(spark, d):
    events = table(spark, d, "events").select("event_id", F.col("props").alias("line"))
    return extract.extract(events, "line").select("event_id", text("line"))


def col_range(spark, d):
    names = table(spark, d, "customer")
    return names.select("c_custkey", F.decode(extract.column_range(F.col("c_name"), "3-9"), "UTF-8").alias("part")).filter("part is not null")


def path_exclusion(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.concat("url", F.when(F.col("page_id") % 3 == 0, ".orig").otherwise(".md5")).alias("path"))
    kept = pages
    for end in EXCLUDED:
        kept = kept.filter(~F.col("path").endswith(end))
    return kept


def split_by_len(spark, d):
    return partition.partition_counts(partition.split_by_length(doc_lines(spark, d), "out"))


def sort_by_len(spark, d):
    lines = doc_lines(spark, d).withColumn("len", byte_length(F.col("line")))
    return ordering.with_ordinal(lines, ordering.by_length(F.col("len"), ORDER)).select(*ORDER, "len", "ord")


def dedupe_hash(spark, d):
    return setops.dedupe_hash(doc_lines(spark, d), ORDER)


def _three(spark, d):
    one = doc_lines(spark, d)
    two = explode_lines(table(spark, d, "benchmark"), "text", ["item_id"]).withColumnRenamed("item_id", "id")
    three = explode_lines(table(spark, d, "conversations"), "text", ["conv_id", "turn"])
    three = three.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "pos", "line")
    return one, two, three


def multi_file_dedupe_counts(spark, d):
    kept = setops.dedupe_files(*_three(spark, d), order=ORDER)
    return kept.groupBy("file_idx").agg(F.count(F.lit(1)).alias("n"))


def sort_check(spark, d):
    return ordering.sortedness_violations(doc_lines(spark, d), ["id"], ["pos"])


def report_counts(spark, d):
    return freq.frequency(doc_lines(spark, d)).select("line", with_commas(F.col("cnt")).alias("shown"))


def remove_metrics(spark, d):
    counted = setops.removal_counts(doc_lines(spark, d), lists(spark, d))
    values = {c: F.max(F.when(F.col("metric") == c, F.col("value"))).alias(c) for c in ("total", "uniques", "duplicates", "written")}
    return counted.agg(*values.values())


L = """with l as (select id, i - 1 as pos, t[i] as line from (
    select doc_id as id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) t,
           unnest(range(1, len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) + 1)) i
    from documents where octet_length(encode(text)) > 0)),
b as (select unnest(string_split(text, chr(10))) line, item_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 pos from benchmark),
c as (select unnest(string_split(text, chr(10))) line, conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) - 1 pos from conversations),
r as (select 1 f, line from b union all select 2 f, line from c),
rk as (select *, row_number() over (partition by line order by id, pos) rn from l),
d as (select id, pos, line from rk where rn = 1)
"""
N, HEX = "octet_length(encode(line))", "hex(encode(line))"

ORACLE: dict[str, str] = {
    "scan_lines": "select id, pos, line from l",
    "dedupe_first": "select * from d",
    "dedupe_duplicates": "select id, pos, line from rk where rn > 1",
    "dedupe_stats": "select count(*) total, count(distinct line) uniques, count(*) - count(distinct line) duplicates from l",
    "remove_dedupe": "select * from d where line not in (select line from r)",
    "remove_keep_dups": "select id, pos, line from l where line not in (select line from r)",
    "remove_merge": "select * from d where line not in (select line from r)",
    "common_dedupe": "select * from d where line in (select line from r)",
    "common_keep_dups": "select id, pos, line from l where line in (select line from r)",
    "remove_attribution": "select f::int file_idx, count(*) removed from d join (select line, min(f) f from r group by line) using (line) group by f",
    "match_counts": "select f::int file_idx, count(*) matched from d join (select line, min(f) f from r group by line) using (line) group by f",
    "remove_union": "select distinct line from r",
    "sort_bytes": "select line, row_number() over (order by line) ord from d",
    "restore_order": "select id, pos, row_number() over (order by id, pos) ord from d",
    "prefix_dedupe": f"select id, pos, line from (select *, row_number() over (partition by substr({HEX}, 1, 16) order by line, id, pos) k from l) where k = 1",
    "prefix_remove": f"select id, pos, line from l where substr({HEX}, 1, 8) not in (select substr({HEX}, 1, 8) from r)",
    "prefix_common": f"select id, pos, line from l where substr({HEX}, 1, 8) in (select substr({HEX}, 1, 8) from r)",
    "freq_count_len_line": f"select line, count(*) cnt, {N}::bigint len from l group by line",
    "freq_running": f"""select line, cnt, {N}::bigint len, cnt::double * 100.0::double / sum(cnt) over ()::double pct,
        (sum(cnt) over (order by cnt desc, line rows unbounded preceding))::double * 100.0::double / (sum(cnt) over ())::double cumul
        from (select line, count(*) cnt from l group by line)""",
    "hist_len": f"""select len, cnt, cnt::double * 100.0::double / (sum(cnt) over ())::double pct,
        (sum(cnt) over (order by cnt desc, len rows unbounded preceding))::double * 100.0::double / (sum(cnt) over ())::double cumul
        from (select {N}::bigint len, count(*) cnt from d group by 1)""",
    "len_minmax": f"select min({N})::bigint min_len, max({N})::bigint max_len from l",
    "canonical_lines": f"select id, pos, {HEX} key_hex, {HEX} value_hex from l",
    "key_prefix": f"select id, pos, substr({HEX}, 1, 10) prefix_hex from l",
    "rehex": f"""select id, pos, case when regexp_matches(line, '[\\x00-\\x1f:\\x7f]') or {N} <> length(line)
        then '$HEX[' || lower({HEX}) || ']' else line end coded from l""",
    "rehex_classes": f"""select id, pos, case when regexp_matches(line, '[\\x00-\\x1f:\\x7fx-z,]')
        then '$HEX[' || lower({HEX}) || ']' else line end coded from l""",
    "unhex_roundtrip": "select id, pos, line from l",
    "recoded_length": f"""select id, pos, (case when regexp_matches(line, '[\\x00-\\x1f:\\x7f]') or {N} <> length(line)
        then 2 * {N} + 6 else {N} end)::bigint len from l""",
    "field_last": "select event_id, regexp_extract(props, '^.+:([^:]*)$', 1) field from events where regexp_matches(props, '^.+:[^:]*$')",
    "field_last_coded": "select event_id, regexp_extract(props, '^.+:([^:]*)$', 1) line from events where regexp_matches(props, '^.+:[^:]*$')",
    "field_nth": "select page_id, string_split(url, '/')[4] field from pages where len(string_split(url, '/')) >= 4",
    "col_range": "select c_custkey, substr(c_name, 3, 6) part from customer where length(c_name) >= 9",
    "path_exclusion": "select page_id, url || '.md5' path from pages where page_id % 3 <> 0",
    "split_by_len": f"""select 'out_' || case when n < 100 then lpad(n::varchar, 2, '0') else n::varchar end file, count(*) n from
        (select case when regexp_matches(line, '[\\x00-\\x1f:\\x7f]') or {N} <> length(line) then 2 * {N} + 6 else {N} end n from l) group by 1""",
    "sort_by_len": f"select id, pos, {N}::bigint len, row_number() over (order by {N}, id, pos) ord from l",
    "dedupe_hash": "select * from d",
    "multi_file_dedupe_counts": """select f::int file_idx, count(*) n from (select line, min(f) f from
        (select 1 f, line from l union all select 2 f, line from b union all select 3 f, line from c) group by line) group by f""",
    "sort_check": "select * from (select id, pos, line, lag(line) over (partition by id order by pos) prev from l) where prev > line",
    "report_counts": "select line, format('{:,}', count(*)) shown from l group by line",
    "remove_metrics": """select count(*) total, count(distinct line) uniques, count(*) - count(distinct line) duplicates,
        (select count(*) from d where line not in (select line from r)) written from l""",
}

QUERIES = {name: globals()[name] for name in ORACLE}
ORACLE = {name: sql if name in ("field_last", "field_last_coded", "field_nth", "col_range", "path_exclusion") else L + sql for name, sql in ORACLE.items()}
