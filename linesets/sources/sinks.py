"""Sinks: ordered lines, duplicates beside them, files by length, reports."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesets.sources.lines import _fs


def _part_files(spark: SparkSession, folder: str) -> list:
    fs, jpath = _fs(spark, folder)
    return sorted((s.getPath() for s in fs.listStatus(jpath) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())


def concat(spark: SparkSession, sources: list, target: str) -> None:
    """Files, in order, as one file that is swapped in when complete; streams through the driver."""
    fs, out_path = _fs(spark, target)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    staged = jvm.org.apache.hadoop.fs.Path(f"{target}.{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    try:
        for part in sources:
            into = fs.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(into, out, conf, False)
            finally:
                into.close()
    finally:
        out.close()
    # renamed over the target in one step where the file system can, else after a delete
    try:
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(staged), fs.makeQualified(out_path), options)
    except Py4JJavaError:
        fs.delete(out_path, False)
        fs.rename(staged, out_path)


def write_lines(df: DataFrame, target: str, order: Sequence, line: str = "line", single: bool = True) -> None:
    """Lines in order, newline-terminated.

    single gives one file of that name, swapped in after it is complete, so the
    target may be one of the inputs; else a folder of part files, written by the tasks, whose names
    give their order. Without an order each task writes what it reads.
    """
    spark = df.sparkSession
    # bytes pass through the text writer unharmed as a string column
    text = (df.orderBy(*order) if order else df).select(F.col(line).cast("binary").cast("string").alias("value"))
    folder = f"{target}.parts-{uuid.uuid4().hex}" if single else target
    text.write.option("lineSep", "\n").text(folder)
    if single:
        concat(spark, _part_files(spark, folder), target)
        fs, jpath = _fs(spark, folder)
        fs.delete(jpath, True)


def write_stdout(df: DataFrame, order: Sequence, line: str = "line", stream=None) -> int:
    stream, n = stream or sys.stdout.buffer, 0
    for row in df.orderBy(*order).select(F.col(line).cast("binary").alias("line")).toLocalIterator(prefetchPartitions=True):
        stream.write(bytes(row["line"]) + b"\n")
        n += 1
    return n


def write_split(split: DataFrame, folder: str, order: Sequence, line: str = "line") -> DataFrame:
    """One file for each length in a folder, appended to if it is there."""
    spark = split.sparkSession
    staged = f"{folder}/.staged-{uuid.uuid4().hex}"
    # a length with most lines is sorted by many tasks; part files keep the order
    rows = split.orderBy("len", *order).select("file", F.col(line).cast("binary").cast("string").alias("value"))
    rows.write.option("lineSep", "\n").partitionBy("file").text(staged)
    fs, jpath = _fs(spark, staged)
    for status in fs.listStatus(jpath):
        name = status.getPath().getName()
        if name.startswith("file="):
            target = f"{folder}/{name[len('file=') :]}"
            there = _fs(spark, target)[1]
            concat(spark, [there] * fs.exists(there) + _part_files(spark, status.getPath().toString()), target)
    fs.delete(jpath, True)
    return split.groupBy("file", "len").agg(F.count(F.lit(1)).alias("n")).orderBy("len").select("file", "n")


def write_by_length(split: DataFrame, folder: str, target: str, order: Sequence, line: str = "line") -> list:
    """One file of lines by length: what the files of these lengths hold already, then the new lines; the files go.

    Gives (file, n) of the new lines, by length.
    """
    spark = split.sparkSession
    counts = write_split(split, folder, order, line).collect()
    files = [_fs(spark, f"{folder}/{r['file']}")[1] for r in counts]
    concat(spark, files, target)
    fs = _fs(spark, folder)[0]
    for f in files:
        fs.delete(f, False)
    return counts


def observed(df: DataFrame, name: str = "lines"):
    """The input with an Observation that counts rows as they pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
