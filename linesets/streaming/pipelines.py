"""The one-pass operators over unbounded inputs.

Re-encoding, extraction and length partitioning keep no state. Dedup keeps
every key it has seen; within() bounds that by a watermark where the data have
an event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesets.functions.codec import ByteClass, recode
from linesets.functions.extract import extract
from linesets.functions.keys import line_hash, output_value
from linesets.operators.partition import split_by_length


def read_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Lines of files as they arrive in a folder, as binary `line`."""
    reader = spark.readStream.option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(folder).select(output_value(F.col("value").cast("binary")).alias("line"))


def recoded(lines: DataFrame, decode: bool = False, byte_class: ByteClass | None = None) -> DataFrame:
    return lines.withColumn("line", recode(F.col("line"), decode, byte_class))


def extracted(lines: DataFrame, **options) -> DataFrame:
    return extract(lines, "line", **options)


def deduped(lines: DataFrame, decode: bool = False, byte_class: ByteClass | None = None, by_hash: bool = False) -> DataFrame:
    """First arrival of each re-encoded line; by_hash keeps 8 bytes a line."""
    coded = recoded(lines, decode, byte_class)
    if by_hash:
        return coded.withColumn("_hash", line_hash(F.col("line"))).dropDuplicates(["_hash"]).drop("_hash")
    return coded.dropDuplicates(["line"])


def within(lines: DataFrame, time: str, delay: str) -> DataFrame:
    """Dedup that forgets keys older than the watermark."""
    return lines.withWatermark(time, delay).dropDuplicatesWithinWatermark(["line"])


def split(lines: DataFrame, template: str, **options) -> DataFrame:
    return split_by_length(lines, template, "line", **options)


def write_stream(lines: DataFrame, folder: str, checkpoint: str, once: bool = True):
    """Starts a text sink; once stops after what is there now."""
    text = lines.select(F.col("line").cast("binary").cast("string").alias("value"))
    writer = text.writeStream.format("text").option("lineSep", "\n").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
