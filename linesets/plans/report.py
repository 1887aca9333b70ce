"""Text of the analysis report: columns chosen by letters, C number formats."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesets.operators.frequency import frequency_order, running

# The letters of the report and their headings.
HEADINGS = {"c": "Count", "l": "Length", "w": "Line", "s": "Percent\tCumulative"}


def parse_letters(spec: str) -> tuple[list[str], bool]:
    """Columns in order (repeats allowed) and whether the histogram is wanted."""
    columns: list[str] = []
    histogram = False
    for letter in spec:
        if letter == "a":
            columns += ["c", "l", "w"]
            histogram = True
        elif letter == "h":
            histogram = True
        elif letter in HEADINGS:
            columns.append(letter)
    if not columns and not histogram:
        raise ValueError(f"no known letter in {spec!r}; use c a h w s l")
    return columns, histogram


def two_places(value: float) -> str:
    """As C prints %.2f: of the double itself, so 0.125 gives 0.12."""
    return "%.2f" % value


def frequency_lines(freq: DataFrame, columns: list[str], key: str = "line") -> Iterator[bytes]:
    """Report lines, streamed partition by partition; in the order of counts, then of the lines' identities."""
    if not columns:
        return
    yield "\t".join(HEADINGS[c] for c in columns).encode()
    by = "key" if "key" in freq.columns else key
    rows = running(freq, by) if "s" in columns else freq
    for row in frequency_order(rows, by).select("*", F.col(key).cast("binary").alias("_raw")).toLocalIterator():
        cells = []
        for c in columns:
            if c == "c":
                cells.append(str(row["cnt"]).encode())
            elif c == "l":
                cells.append(str(row["len"]).encode())
            elif c == "w":
                cells.append(bytes(row["_raw"]))
            else:
                cells.append(f"{two_places(row['pct'])}\t{two_places(row['cumul'])}".encode())
        yield b"\t".join(cells)


def histogram_lines(histogram: DataFrame) -> Iterator[bytes]:
    yield b"Count\tLength\tPercent\tCumulative"
    for row in histogram.orderBy(F.col("cnt").desc(), F.col("len")).toLocalIterator():
        yield f"{row['cnt']:,}\t{row['len']}\t{two_places(row['pct'])}\t{two_places(row['cumul'])}".encode()
