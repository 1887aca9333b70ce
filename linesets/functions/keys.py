"""Column expressions for line identity: byte-faithful, JVM side, no UDF.

A line is binary (canonical) or string. Regular expressions on a string that
is not valid UTF-8 would corrupt it, so binary columns go through ISO-8859-1,
where one character is one byte and order is kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LATIN1 = "ISO-8859-1"


def as_binary(line: Column) -> Column:
    return line.cast("binary")


def latin1(line: Column) -> Column:
    """The line's bytes as a string of one character per byte."""
    return F.decode(as_binary(line), LATIN1)


def from_latin1(text: Column) -> Column:
    return F.encode(text, LATIN1)


def canonical_key(raw: Column) -> Column:
    """Identity of a raw line: each CR goes, and the byte after it is literal."""
    return from_latin1(F.regexp_replace(latin1(raw), r"(?s)\r(.?)", "$1"))


def output_value(raw: Column) -> Column:
    """What is written for a raw line: all of it but one trailing CR."""
    return from_latin1(F.regexp_replace(latin1(raw), r"\r\z", ""))


def prefix_key(raw: Column, n: int) -> Column:
    """Identity by the first n bytes; a shorter line counts whole."""
    return F.substring(canonical_key(raw), 1, n)


def byte_length(line: Column) -> Column:
    return F.octet_length(as_binary(line)).cast("bigint")


def output_length(raw: Column) -> Column:
    return byte_length(output_value(raw))


def line_hash(line: Column) -> Column:
    return F.xxhash64(as_binary(line))


def with_commas(n: Column) -> Column:
    return F.format_number(n, 0)
