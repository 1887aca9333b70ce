"""Tables, the shared folder and worker paths for the operators of this subpackage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes that go to a Python worker at once: texts are copied a few times there.
BATCH_ROWS, BATCH_BYTES = 2048, 16 << 20


def with_workers(spark: SparkSession) -> None:
    """Python workers started from now on find this package where its folder is visible to them.

    Arrow batches of the session get no larger than the bounds above.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > most or int(now.rstrip("b")) <= 0:
            spark.conf.set(key, most)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def _give_back() -> None:
    """Returns freed memory of this process to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_caches: list[tuple[str, dict]] = []


def worker_cache(user: str) -> dict:
    """What a worker keeps from task to task for the operator in module `user`; it goes when another operator's task starts."""
    held: dict = {}
    _caches.append((user, held))
    return held


def _enter(user: str) -> None:
    for owner, held in _caches:
        if owner != user:
            held.clear()


def tidy(run):
    """run over Arrow batches; a worker that waits for its next task holds only what it still uses."""

    def tidied(batches):
        _enter(run.__module__)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; one of its own in local mode where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # the setting can't be changed in a session that runs
        base = _own_dirs.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="linesets-")
        _own_dirs[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


def _place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, with the scheme of its file system, so workers see whether it is a mounted one."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/linesets/{name}-{uuid.uuid4().hex}")
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(jpath).toString()


_open: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are materialized meanwhile are deleted at the end, also if a step fails."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    path = _place(spark, name)
    if _open:
        _open[-1].append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage is cut, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def result(df: DataFrame, name: str) -> str:
    """Where df was written: a table that stays when the scratch tables around it go; it belongs to what is around those."""
    path = _place(df.sparkSession, name)
    if len(_open) > 1:
        _open[-2].append(path)
    df.write.parquet(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def discard(*frames: DataFrame) -> None:
    """Deletes materialized tables that no later step reads."""
    for df in frames:
        for found in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, found)
