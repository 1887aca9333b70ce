"""Field extraction from delimited lines: each returns a null where the row goes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesets.functions.codec import ByteClass, recode
from linesets.functions.keys import as_binary, byte_length, from_latin1, latin1, output_value


def delimiter_byte(spec: str) -> str:
    """One character of a delimiter given as itself, decimal or 0x.. ."""
    if len(spec) == 1 and not spec.isdigit():
        return spec
    return chr(int(spec, 16) if spec.lower().startswith("0x") else int(spec))


def last_field(line: Column, delimiter: str = ":") -> Column:
    """Bytes after the last delimiter, if one stands after the first byte."""
    text = latin1(output_value(line))
    d = re.escape(delimiter_byte(delimiter))
    pattern = f"(?s)^.+{d}([^{d}]*)$"
    return F.when(text.rlike(pattern.replace("$", r"\z")), from_latin1(F.regexp_extract(text, pattern.replace("$", r"\z"), 1)))


def nth_field(line: Column, n: int, delimiter: str = ":") -> Column:
    """The n-th field from 1; null where there are fewer."""
    if n < 1:
        raise ValueError("fields count from 1")
    d = "\\Q" + delimiter_byte(delimiter) + "\\E"
    return from_latin1(F.get(F.split(latin1(line), d, -1), n - 1))


def parse_columns(spec: str) -> tuple[int, int | None]:
    """'3-9' is bytes 3 to 8 (end-exclusive); '3-' to the end; '-6' the first 6."""
    low, dash, high = spec.partition("-")
    if not dash:
        raise ValueError("a column range is N-M, N- or -M")
    if not low:
        return 1, int(high) + 1
    return int(low), int(high) if high else None


def column_range(line: Column, spec: str) -> Column:
    low, high = parse_columns(spec)
    value = output_value(line)
    if high is None:
        rest = F.substring(value, F.lit(low), byte_length(value).cast("int"))
        return F.when(byte_length(value) >= low, rest)
    fits = (byte_length(value) >= low) & (byte_length(as_binary(line)) >= high)
    if spec.startswith("-"):
        fits = byte_length(value) >= high - 1
    return F.when(fits, F.substring(value, low, high - low))


def extract(
    df: DataFrame,
    column: str = "line",
    field: int | None = None,
    columns: str | None = None,
    delimiter: str = ":",
    decode: bool = False,
    byte_class: ByteClass | None = None,
) -> DataFrame:
    """Rows whose field exists, with the field re-encoded (or decoded) in place."""
    line = F.col(column)
    if field is not None:
        value = nth_field(line, field, delimiter)
    elif columns is not None:
        value = column_range(line, columns)
    else:
        value = last_field(line, delimiter)
    found = df.withColumn(column, value).filter(F.col(column).isNotNull())
    return found.withColumn(column, recode(F.col(column), decode, byte_class))
