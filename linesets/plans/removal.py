"""The engine's main plan: dedup, then remove or keep what other lists hold.

raw lines -> key, value -> [first of each key] -> anti or semi join -> order.
The key carries the CR rules; the value is what gets written. All modes of the
command line differ only in hints, so hash and merge give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesets.functions.keys import canonical_key, output_value
from linesets.operators import frequency as freq
from linesets.operators import order as ordering
from linesets.operators import setops
from linesets.sources.lines import ORDER

MODES = {"hash": None, "search": None, "file": None, "merge": "merge"}


@dataclass(frozen=True)
class Removal:
    dedupe: bool = True
    keep_common: bool = False
    sort: bool = False
    prefix: int | None = None
    mode: str = "hash"

    def keyed(self, lines: DataFrame) -> DataFrame:
        """(place.., key, ident, line): key is the whole line's identity, ident what decides equality, line what gets written."""
        whole = canonical_key(F.col("raw"))
        return lines.select(*ORDER, whole.alias("key"), self._ident(whole).alias("ident"), output_value(F.col("raw")).alias("line"))

    def _ident(self, key: Column) -> Column:
        return F.substring(key, 1, self.prefix) if self.prefix else key

    def places(self) -> list[str]:
        """Which row of those with one ident comes first: with a prefix the smallest line."""
        return ["key", *ORDER] if self.prefix else ORDER

    def keys(self, removes: list[DataFrame]) -> DataFrame | None:
        tagged = [r.select(self._ident(canonical_key(output_value(F.col("raw")))).alias("line")) for r in removes]
        return setops.union_removes(*tagged) if tagged else None

    def first(self, keyed: DataFrame) -> DataFrame:
        return setops.dedupe_first(keyed, self.places(), "ident") if self.dedupe else keyed

    def check(self, lines: DataFrame, removes: list[DataFrame]) -> None:
        """Merge mode asks for sorted files, and says where one isn't."""
        if self.mode == "merge":
            for one in (lines, *removes):
                ordering.require_sorted(one.select("file_idx", "block", canonical_key(F.col("raw")).alias("line")))

    def run(self, lines: DataFrame, removes: list[DataFrame]) -> DataFrame:
        kept, keys = self.first(self.keyed(lines)), self.keys(removes)
        if keys is None:
            return kept.limit(0) if self.keep_common else kept
        return (setops.common if self.keep_common else setops.remove)(kept, keys, "ident", MODES[self.mode])

    def order(self) -> list[str]:
        return ["key", *ORDER] if self.sort or self.mode == "merge" else ORDER

    def duplicates(self, lines: DataFrame) -> DataFrame:
        """What dedup took away; nothing if duplicates are kept."""
        keyed = self.keyed(lines)
        return setops.duplicates(keyed, self.places(), "ident") if self.dedupe else keyed.limit(0)

    def figures(self, lines: DataFrame, removes: list[DataFrame]) -> DataFrame:
        """(metric, value): total, uniques, duplicates, rows taken by each list (list_k) and by all (matched), and written."""
        return setops.removal_counts(self.keyed(lines), self.keys(removes), "ident", self.dedupe, self.keep_common)

    def metrics(self, lines: DataFrame, removes: list[DataFrame]) -> DataFrame:
        """(metric, value): totals, and rows taken by each list."""
        return self.figures(lines, removes).filter(~F.col("metric").isin("matched", "written"))

    def matches(self, lines: DataFrame, removes: list[DataFrame]) -> DataFrame | None:
        """(file_idx, matched): distinct idents first met in list k."""
        keys = self.keys(removes)
        return None if keys is None else freq.match_counts(self.keyed(lines).select(F.col("ident").alias("line")), keys)

    def frequency(self, lines: DataFrame) -> DataFrame:
        """(key, cnt, line, len) over the whole input; the first occurrence stands for its key."""
        place = F.struct(*[F.col(c) for c in ORDER], F.col("line"))
        counted = self.keyed(lines).groupBy("key").agg(F.count(F.lit(1)).alias("cnt"), F.min(place).alias("_first"))
        return counted.select("key", "cnt", F.col("_first.line").alias("line")).withColumn("len", F.octet_length("line").cast("bigint"))
