"""Passage dedup: runs of words that repeat anywhere in a text; DataFrame functions alone.

Line dedup compares whole lines. Here a text is its words (runs of non-blank
ASCII, as they stand) and a unit is every window of `window` consecutive words,
across newlines and from the middle of one line to the middle of another. Of a
window's places (by doc_id, then content, then word) the first stays and the words
of all others go, so a later copy of a passage of `window` words or more goes
whole, whatever text it is spliced into.

One row for each window of a corpus would be many times its size. A window is
therefore named by its smallest hash of `GRAM` words, which equal windows share,
and neighbours with one name are one row (about one for 22 words). Only windows
whose name occurs more than once can repeat; those alone are compared, by two
independent 64-bit hashes of all their words.

A word goes with the blanks behind it. Null texts and texts of fewer words stay as
they are; rows equal in doc_id and text are one document and get the same result; a
null doc_id comes first in the order. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesets.llm import line_dedup
from linesets.llm._common import materialize, result, scratch, table

WINDOW = 50
GRAM = 8
BLANK = r"[ \t-\r]"
#: Column that cut_passages adds; one of this name in the input is replaced.
N_WORDS_CUT = "passage_words_cut"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pieces(text: Column) -> Column:
    """Words with the blanks behind them; blanks that start the text are left out."""
    return F.split(F.regexp_replace(text, rf"^{BLANK}+", ""), rf"(?<={BLANK})(?!{BLANK})(?!$)", -1)


def _hashes(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", ""), rf"{BLANK}+", -1), lambda w: F.xxhash64(w))


def _up_to(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _names(text: Column, window: int, gram: int) -> Column:
    """(name, a, b, again) of each run of windows, from a to b, that have one name; again: it stands in them twice."""
    width = window - gram + 1

    def twice(grams: Column, name: Column, a: Column, length: Column) -> Column:
        at = F.array_position(F.slice(grams, a + 1, length), name).cast("int")
        return F.array_contains(F.slice(grams, a + 1 + at, length - at), name)

    def runs(grams: Column, names: Column) -> Column:
        heads = F.filter(_up_to(F.size(names)), lambda i: (i == 0) | (F.get(names, i) != F.get(names, i - 1)))
        ends = lambda hs, j: F.coalesce(F.get(hs, j + 1), F.size(names)) - 1
        both = _let(heads, lambda hs: F.transform(hs, lambda a, j: F.struct(F.get(names, a).alias("name"), a.alias("a"), ends(hs, j).alias("b"))))
        return F.transform(both, lambda r: F.struct(
            r["name"].alias("name"), r["a"].alias("a"), r["b"].alias("b"), twice(grams, r["name"], r["a"], r["b"] - r["a"] + width).alias("again"),
        ))

    def of_grams(grams: Column) -> Column:
        least = F.transform(_up_to(F.size(grams) - width + 1), lambda i: F.array_min(F.slice(grams, i + 1, width)))
        return _let(least, lambda names: runs(grams, names))

    def of_words(words: Column) -> Column:
        return _let(F.transform(_up_to(F.size(words) - gram + 1), lambda i: F.xxhash64(F.slice(words, i + 1, gram))), of_grams)

    return _let(_hashes(text), of_words)


def _merged(starts: Column, window: int) -> Column:
    """Sorted starts of windows as runs of words, (low, high) each."""
    low = lambda x, j: (j == 0) | (x > F.get(starts, j - 1) + window)
    high = lambda x, j: (j == F.size(starts) - 1) | (F.get(starts, j + 1) > x + window)
    return F.zip_with(F.filter(starts, low), F.filter(starts, high), lambda a, b: F.struct(a.alias("low"), (b + window).alias("high")))


def repeated_passages(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(_id, _hash, _cut): documents that hold later windows, and the runs of words in them: (low, high), from 0, sorted, without high."""
    spark, gram = docs.sparkSession, min(gram, window)
    with scratch(spark):
        own = docs.filter(F.octet_length(text) > 0).select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
        named = own.select("_id", "_hash", F.explode(_names(F.col("_text"), window, gram)).alias("u")).select("_id", "_hash", "u.*")
        named = materialize(named, "passage-names")
        several = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).filter("n > 1 or again").select("name")
        spans = named.join(several, "name").groupBy("_id", "_hash").agg(F.collect_set(F.struct("a", "b")).alias("_spans"))
        spans = spans.withColumnsRenamed({"_id": "_span_id", "_hash": "_span_hash"})
        held = own.join(spans, F.col("_id").eqNullSafe(F.col("_span_id")) & (F.col("_hash") == F.col("_span_hash")))
        asked = F.flatten(F.transform("_spans", lambda s: F.sequence(s["a"], s["b"])))

        def unit(words: Column, i: Column) -> Column:
            part = F.slice(words, i + 1, window)
            return F.struct(i.alias("start"), F.xxhash64(part).alias("x"), F.xxhash64(F.lit(line_dedup.SECOND_SEED), part).alias("y"))

        units = _let(_hashes(F.col("_text")), lambda words: F.transform(asked, lambda i: unit(words, i)))
        units = materialize(held.select("_id", "_hash", F.explode(units).alias("u")).select("_id", "_hash", "u.*"), "passages")
        place = F.struct("_id", "_hash", "start")
        firsts = units.groupBy("x", "y").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        later = units.join(firsts, ["x", "y"]).filter(place > F.col("first"))
        cut = later.groupBy("_id", "_hash").agg(F.sort_array(F.collect_set("start")).alias("_starts"))
        found = cut.select("_id", "_hash", _let(F.col("_starts"), lambda s: _merged(s, window)).alias("_cut"))
        path = result(found, "passage-cuts")
    return spark.read.schema(found.schema).parquet(path)


def cut_passages(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with later copies of passages cut from the text, and how many words went."""
    cuts = repeated_passages(docs, text, id_col, window, gram)
    rest = [c for c in docs.columns if c not in (text, N_WORDS_CUT)]
    # the row travels as one column, so that no name of the input can clash
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    own = docs.select(whole.alias("row"), F.col(text).alias("body"), F.col(id_col).alias("own_id"), F.xxhash64(text).alias("own_hash"))
    joined = own.join(cuts, own["own_id"].eqNullSafe(cuts["_id"]) & (own["own_hash"] == cuts["_hash"]), "left")

    def between(pieces: Column, j: Column) -> Column:
        low = F.when(j == 0, 0).otherwise(F.get("_cut", j - 1)["high"])
        high = F.coalesce(F.get("_cut", j)["low"], F.size(pieces))
        return F.array_join(F.slice(pieces, low + 1, high - low), "")

    kept = _let(_pieces(F.col("body")), lambda pieces: F.array_join(F.transform(F.sequence(F.lit(0), F.size("_cut")), lambda j: between(pieces, j)), ""))
    added = {
        text: F.when(F.col("_cut").isNull(), F.col("body")).otherwise(F.concat(F.regexp_extract("body", rf"^{BLANK}*", 0), kept)),
        N_WORDS_CUT: F.coalesce(F.aggregate("_cut", F.lit(0), lambda n, c: n + c["high"] - c["low"]), F.lit(0)).cast("bigint"),
    }
    place = {c: F.col(f"row.c{i}") for i, c in enumerate(rest)} | added
    order = [c for c in docs.columns if c != N_WORDS_CUT] + [N_WORDS_CUT]
    return joined.select(*[place[c].alias(c) for c in order])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines, n_cut = F.col(line_dedup.N_LINES).alias("n_lines"), F.col(line_dedup.N_CUT).alias("n_cut")
    with scratch(spark):
        out = cut_passages(materialize(line_dedup.dedup_lines(docs), "line-deduped"))
        out = out.select("doc_id", n_lines, n_cut, F.col(N_WORDS_CUT).alias("n_words_cut"), F.col("text").alias("kept_text"))
        path = result(out, "passages-cut")
    return spark.read.schema(out.schema).parquet(path)
