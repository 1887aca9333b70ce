"""Line sources: files of bytes and text columns of tables.

Every source gives (file_idx, block, seq, raw): raw is binary without its
newline; (file_idx, block, seq) is the place of a row, kept as columns because
Spark packs file splits by size, not in order.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["file_idx", "block", "seq"]
SCHEMA = "file_idx int, block bigint, seq bigint, raw binary"
# First bytes of gzip data; file name endings left out by default.
GZIP_MAGIC = b"\x1f\x8b"
EXCLUDED = (".txt", ".orig", ".test", ".csalt.txt", ".fixme", ".new")


def parse_size(spec: str) -> int:
    """Bytes of '64', '4k', '2m' or '1g'."""
    factor = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(spec[-1:].lower())
    return int(spec[:-1]) * factor if factor else int(spec)


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def resolve(
    spark: SparkSession, paths: Iterable[str], ignore_missing: bool = False, skip: str | None = None
) -> tuple[list[str], list[str]]:
    """Existing files in argument order, and messages about those left out.

    Globs expand (a pattern without a match stands for itself), folders and a
    path spelled like `skip` are left out, and a missing file is an error unless
    ignore_missing.
    """
    found, said = [], []
    for path in paths:
        if path == skip:
            said.append(f"{path}: same as the input, skipped")
            continue
        fs, jpath = _fs(spark, path)
        matches = fs.globStatus(jpath)
        if not matches:
            if not ignore_missing:
                raise FileNotFoundError(path)
            said.append(f"{path}: not found, skipped")
            continue
        for status in matches:
            if status.isDirectory():
                said.append(f"{status.getPath()}: a folder, skipped")
            else:
                found.append(status.getPath().toString())
    return found, said


def select_paths(spark: SparkSession, paths: Iterable[str], excluded: Sequence[str] | None = EXCLUDED, expand: bool = True) -> list[str]:
    """Paths less those with excluded endings; x.txt stands for the other x.*.

    excluded None turns both rules off.
    """
    chosen: list[str] = []
    for path in paths:
        if excluded is not None and expand and path.endswith(".txt"):
            fs, jpath = _fs(spark, path[: -len("txt")] + "*")
            names = sorted(s.getPath().toString() for s in fs.globStatus(jpath) or [])
            chosen += [n for n in names if not n.endswith(tuple(excluded))]
        elif excluded is None or not path.endswith(tuple(excluded)):
            chosen.append(path)
    return chosen


def read_exclusions(text: str) -> tuple[str, ...]:
    """File name endings, one a line."""
    return tuple(e.strip() for e in text.splitlines() if e.strip())


def _is_gzip(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    stream = fs.open(jpath)
    try:
        return bytes(b & 0xFF for b in (stream.read(), stream.read())) == GZIP_MAGIC
    finally:
        stream.close()


def _scratch(spark: SparkSession) -> str:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


#: Files put into the shared folder for a reader; delete_staged() takes them away.
_staged: list[str] = []


def delete_staged(spark: SparkSession) -> None:
    while _staged:
        fs, jpath = _fs(spark, _staged.pop())
        fs.delete(jpath, False)


def _marked(spark: SparkSession, path: str) -> str:
    """The path of gzip data that the text reader streams through its codec, which goes by the ending: if need be a copy."""
    if path.endswith(".gz") or not _is_gzip(spark, path):
        return path
    copy = f"{_scratch(spark)}/unzip-{uuid.uuid4().hex}.gz"
    (fs, source), (to, target) = _fs(spark, path), _fs(spark, copy)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, to, target, False, spark.sparkContext._jsc.hadoopConfiguration())
    _staged.append(copy)
    return copy


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines of files in their order; gzip by content; no limit on a line.

    One scan reads all files, each once, and a file's number comes from its path.
    """
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    with ThreadPoolExecutor(16) as pool:  # a file's first bytes tell what it is
        marked = list(pool.map(lambda p: _marked(spark, p), paths))
    # as the scan names them
    names = [_fs(spark, p)[0].makeQualified(_fs(spark, p)[1]).toUri().toString() for p in marked]
    # without lineSep the reader also splits at a lone CR
    text = spark.read.option("lineSep", "\n").text(list(dict.fromkeys(marked)))
    rows = text.select(
        F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").cast("binary").alias("raw"),
    )
    if len(names) == 1:
        return rows.select(F.lit(1).alias("file_idx"), "block", "seq", "raw")
    files = spark.createDataFrame([(re.sub("^file:/+", "file:/", n), i) for i, n in enumerate(names, 1)], "_path string, file_idx int")
    # one short row for each file named on the command line
    return rows.join(F.broadcast(files), "_path").select("file_idx", "block", "seq", "raw")


def lines_of(texts: Column) -> Column:
    """Array of a text's lines: one final newline ends the last line; '' has none."""
    body = F.when(texts.endswith("\n"), F.substr(texts, F.lit(1), F.char_length(texts) - 1)).otherwise(texts)
    return F.when(F.coalesce(F.octet_length(texts), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, if a small input comes in fewer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def explode_lines(df: DataFrame, text: str, ids: Sequence[str]) -> DataFrame:
    """(ids.., pos, line) of every line of a text column; null texts have none."""
    exploded = df.select(*ids, F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    return exploded.withColumn("pos", F.col("pos").cast("bigint"))


def spool_stdin(spark: SparkSession, stream, folder: str | None = None) -> str:
    """Copies a byte stream to a file in a folder that all executors see; delete_staged() takes it away."""
    path = f"{folder or _scratch(spark)}/stdin-{uuid.uuid4().hex}"
    fs, jpath = _fs(spark, path)
    out = fs.create(jpath, True)
    _staged.append(path)
    try:
        while chunk := stream.read(1 << 20):
            out.write(bytearray(chunk))
    finally:
        out.close()
    return path
