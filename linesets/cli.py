"""Command line: python -m linesets.cli {remove,dedupe,rehex,extract,split} ..."""

from __future__ import annotations

import argparse
import contextlib
import itertools
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linesets.functions.codec import ByteClass, recode
from linesets.functions.extract import extract
from linesets.functions.keys import output_value
from linesets.operators import setops
from linesets.operators.frequency import length_histogram
from linesets.operators.partition import split_by_length
from linesets.plans.removal import Removal
from linesets.plans.report import frequency_lines, histogram_lines, parse_letters
from linesets.sources import lines as src
from linesets.sources import sinks


class _Classed(argparse.Action):
    """-S and -U apply in the order given."""

    def __call__(self, parser, space, value, option=None):
        now = getattr(space, "byte_class", None) or ByteClass()
        space.byte_class = now.with_set(value) if option == "-S" else now.with_clear(value)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="linesets")
    kinds = top.add_subparsers(dest="kind", required=True)
    rem = kinds.add_parser("remove", help="input output remove...")
    rem.add_argument("files", nargs="+")
    rem.add_argument("-i", dest="ignore", action="store_true")
    rem.add_argument("-d", dest="dedupe", action="store_true", default=True)
    rem.add_argument("-n", dest="dedupe", action="store_false")
    rem.add_argument("-c", dest="common", action="store_true")
    rem.add_argument("-s", dest="sort", action="store_true")
    rem.add_argument("-q", dest="report")
    rem.add_argument("-l", dest="prefix", type=int)
    rem.add_argument("-D", dest="duplicates")
    modes = rem.add_mutually_exclusive_group()
    for flag, mode in (("-b", "search"), ("-f", "file"), ("-2", "merge")):
        modes.add_argument(flag, dest="mode", action="store_const", const=mode, default="hash")
    for flag in ("-t", "-p", "-T"):  # accepted; Spark sizes and places these itself
        rem.add_argument(flag)
    rem.add_argument("-M", type=src.parse_size)
    rem.add_argument("-v", action="store_true")
    rem.add_argument("--parts", action="store_true", help="the output is a folder of part files, written in parallel")
    for kind in ("dedupe", "rehex", "extract", "split"):
        one = kinds.add_parser(kind)
        one.add_argument("files", nargs="*")
        one.add_argument("-u", dest="decode", action="store_true")
        one.add_argument("-S", action=_Classed, dest="_s")
        one.add_argument("-U", action=_Classed, dest="_u")
        if kind != "split":
            one.add_argument("--parts", help="a folder for part files, written in parallel, in place of standard output")
            one.add_argument("--any-order", dest="ordered", action="store_false", help="part files needn't follow the input's order")
        if kind == "dedupe":
            one.add_argument("-x", dest="by_hash", action="store_true")
        elif kind == "extract":
            one.add_argument("-f", dest="field", type=int)
            one.add_argument("-c", dest="columns")
            one.add_argument("-d", dest="delimiter", default=":")
            one.add_argument("-t", dest="expand", action="store_false")
            one.add_argument("-n", dest="all_files", action="store_true")
            one.add_argument("-x", dest="exclusions")
        elif kind == "split":
            one.add_argument("-o", dest="template", required=True)
            one.add_argument("-c", dest="mark", default="#")
            one.add_argument("-s", dest="sorted", action="store_true")
            one.add_argument("-M", type=src.parse_size)
    return top


def _sources(spark: SparkSession, files: list[str], skip: str | None = None) -> list[str]:
    """stdin is spooled where it is named, unless it is skipped; its bytes come once."""
    return [src.spool_stdin(spark, sys.stdin.buffer) if f == "stdin" != skip else f for f in files]


def run_remove(spark: SparkSession, args) -> None:
    source, target, *others = args.files if len(args.files) > 1 else (args.files[0], "stdout")
    found, said = src.resolve(spark, _sources(spark, others, source), args.ignore, skip=source)
    lines, removes = src.read_lines(spark, _sources(spark, [source])), [src.read_lines(spark, [p]) for p in found]
    plan = Removal(args.dedupe, args.common, args.sort, args.prefix, "hash" if args.report else args.mode)
    plan.check(lines, removes)
    for message in said:
        print(message, file=sys.stderr)
    if args.report:
        write_report(args, plan, lines, removes, target)
        return
    kept = plan.run(lines, removes)
    if target == "stdout":
        sinks.write_stdout(kept, plan.order())
    else:
        sinks.write_lines(kept, target, plan.order(), single=not args.parts)
    if args.duplicates:
        sinks.write_lines(plan.duplicates(lines), args.duplicates, src.ORDER, single=not args.parts)
    for row in plan.figures(lines, removes).collect():
        print(f"{row['metric']}: {row['value']:,}", file=sys.stderr)


def write_report(args, plan: Removal, lines, removes, target: str) -> None:
    """Line by line, as the rows arrive; no list of them is held."""
    columns, histogram = parse_letters(args.report)
    frequency = plan.frequency(lines)
    out = frequency_lines(frequency, columns)
    if histogram:
        out = itertools.chain(out, [b""] * 3, histogram_lines(length_histogram(frequency.select("line"))))
    matches = plan.matches(lines, removes)
    for row in matches.orderBy("file_idx").collect() if matches is not None else ():  # one row a list
        print(f"{row['matched']:,} lines matched in list {row['file_idx']}", file=sys.stderr)
    with contextlib.nullcontext(sys.stdout.buffer) if target == "stdout" else open(target, "wb") as stream:
        for line in out:
            stream.write(line + b"\n")
        stream.flush()


def run_filter(spark: SparkSession, args) -> None:
    files = args.files or ["stdin"]
    if args.kind == "extract":
        ends = None if args.all_files else src.EXCLUDED
        if args.exclusions and ends is not None:
            with open(args.exclusions) as listed:
                ends = src.read_exclusions(listed.read())
        files = src.select_paths(spark, files, ends, args.expand) if args.files else files
    found, said = src.resolve(spark, _sources(spark, files), ignore_missing=True)
    for message in said:
        print(message, file=sys.stderr)
    classed = getattr(args, "byte_class", None)
    lines = src.read_lines(spark, found).withColumnRenamed("raw", "line")
    if args.kind == "extract":
        write_filtered(extract(lines, "line", args.field, args.columns, args.delimiter, args.decode, classed), args)
        return
    lines = lines.withColumn("line", output_value(F.col("line")))
    if args.kind == "split":
        folder, name = os.path.split(os.path.abspath(args.template))
        split = split_by_length(lines, name, "line", args.decode, classed, args.mark)
        if args.sorted:
            counts = sinks.write_by_length(split, folder, os.path.join(folder, name), src.ORDER)
        else:
            counts = sinks.write_split(split, folder, src.ORDER).collect()
        for row in counts:
            print(f"{row['n']:,} lines written to {row['file']}", file=sys.stderr)
        return
    coded = lines.withColumn("line", recode(F.col("line"), args.decode, classed))
    if args.kind == "dedupe":
        coded = (setops.dedupe_hash if args.by_hash else setops.dedupe_first)(coded, src.ORDER)
    write_filtered(coded, args)


def write_filtered(lines, args) -> None:
    if args.parts:
        sinks.write_lines(lines, args.parts, src.ORDER if args.ordered else [], single=False)
    else:
        sinks.write_stdout(lines, src.ORDER)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("linesets").getOrCreate()
    try:
        (run_remove if args.kind == "remove" else run_filter)(spark, args)
    finally:
        src.delete_staged(spark)


if __name__ == "__main__":
    main()
