"""Line dedup by winnowing over line hashes; DataFrame functions alone.

A document is its lines, split at newlines. Two kinds of units are compared:

* every window of `window` consecutive lines of a document, and
* every shorter run of lines that has `long_words` words or more, unless a
  part of it has them: a long line, two lines that are long together, and so on.

Winnowing picks the line with the smallest hash of each unit (the rightmost
of equal ones) as its fingerprint; a long line is its own. Two equal units have
the same fingerprint at the same offset, so both pick a position with that line: a repeated run of
`window` lines or more, or one of `long_words` words or more, always shares a fingerprint
with its earlier copy. Neighbouring units mostly pick the same line, so there
are fewer positions than units.

Positions are joined on the fingerprint alone, and only those whose fingerprint stands at
several of them go on; on real text that leaves a small part of the units.
These are matched by all of their lines with the unit's first position in the corpus (by doc_id,
then content, then line), and the match is extended both ways while the lines agree. Every line in
a match whose first position is earlier goes.

The result is the union of all such matches. An extension of window - 1 lines
on each side is all that is needed: a longer agreement holds whole windows that
are units with an earlier position themselves.

Units are compared by two independent 64-bit hashes, lines beside a match by one. Rows: a null or empty text
has no lines and stays as it is; rows equal in doc_id and text are one document
and get the same result; a null doc_id comes first in the order. Other columns
pass through, whatever their names. A very long text is one row of line hashes; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 3
LONG_WORDS = 50
SECOND_SEED = 7919


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(SECOND_SEED), line).alias("b"))


def _n_words(line: Column) -> Column:
    # words are runs of non-blank ASCII; blanks that end or start the line make no word
    trimmed = F.regexp_replace(line, r"^[ \t-\r]+|[ \t-\r]+$", "")
    return F.when(F.octet_length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, r"[ \t-\r]+")))


def _hashed(docs: DataFrame, text: str, id_col: str, window: int, long_words: int) -> DataFrame:
    """One row for each distinct document: _doc (a number), _id, _hash, its lines as hashes and words (long_words for all that
    are long), and for each window the position of its fingerprint."""
    with_lines = docs.filter(F.octet_length(text) > 0).select(
        F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), F.split(F.col(text), "\n", -1).alias("_split")
    )
    words = lambda x: F.least(_n_words(x), F.lit(long_words))
    lines = F.transform("_split", lambda x: F.struct(_hash(x).alias("h"), words(x).alias("words")))
    # of equal hashes the rightmost is the smallest
    ranked = F.transform("_lines", lambda x, i: F.struct(x["h"].alias("h"), (-i).alias("back")))
    hashed = with_lines.select("_id", "_hash", lines.alias("_lines")).distinct().withColumn("_ranked", ranked)
    picked = F.transform(_starts(F.size("_lines"), window), lambda i: -F.array_min(F.slice("_ranked", i + 1, window))["back"])
    return hashed.select(F.monotonically_increasing_id().alias("_doc"), "_id", "_hash", "_lines", picked.alias("_picked"))


def _starts(n: Column, length: int) -> Column:
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


class _Lines:
    """Expressions over a row of _hashed."""

    def __init__(self, window: int, long_words: int):
        self.window, self.long_words = window, long_words
        self.lines, self.n = F.col("_lines"), F.size("_lines")

    def at(self, i: Column) -> Column:
        return F.element_at(self.lines, (i + 1).cast("int"))

    def is_long(self, start: Column, length: int) -> Column:
        return sum((self.at(start + i)["words"] for i in range(length)), F.lit(0)) >= self.long_words

    def least_long(self, length: int) -> Column:
        """Starts of the runs of so many lines that are long together, and of which no part is."""
        if length == 1:
            return F.filter(_starts(self.n, 1), lambda i: self.is_long(i, 1))
        return F.filter(_starts(self.n, length), lambda i: self.is_long(i, length) & ~self.is_long(i, length - 1) & ~self.is_long(i + 1, length - 1))

    def pick(self, start: Column, length: int) -> Column:
        """Position of the fingerprint of a run."""
        ranked = F.transform(F.slice(self.lines, start + 1, length), lambda x, i: F.struct(x["h"].alias("h"), (-i).alias("back")))
        return start - F.array_min(ranked)["back"]

    def shorter(self) -> list[int]:
        return list(range(1, self.window))

    def positions(self) -> Column:
        """Each position that a unit picks, once, with its line's hash."""

        def picks(length: int) -> Column:
            return F.transform(self.least_long(length), lambda i: self.pick(i, length))

        return F.transform(F.array_distinct(F.concat("_picked", *map(picks, self.shorter()))), lambda p: F.struct(p.alias("pos"), self.at(p)["h"]["a"].alias("fingerprint")))

    def units(self, among: Column) -> Column:
        """(start, length, content) of the units that pick one of the positions."""

        def unit(start: Column, length: int) -> Column:
            part = F.transform(F.slice(self.lines, start + 1, length), lambda x: x["h"])
            content = F.struct(F.xxhash64(part).alias("a"), F.xxhash64(F.lit(SECOND_SEED), part).alias("b"))
            return F.struct(start.alias("start"), F.lit(length).alias("length"), content.alias("content"))

        def runs(length: int) -> Column:
            picked = F.filter(self.least_long(length), lambda i: F.array_contains(among, self.pick(i, length)))
            return F.transform(picked, lambda i: unit(i, length))

        windows = F.filter(_starts(self.n, self.window), lambda i: F.array_contains(among, F.element_at("_picked", i + 1)))
        return F.concat(F.transform(windows, lambda i: unit(i, self.window)), *map(runs, self.shorter()))


def _units(hashed: DataFrame, window: int, long_words: int) -> DataFrame:
    """One row for each unit whose fingerprint stands at several positions: its content, its place and the hashes around it."""
    doc = _Lines(window, long_words)
    positions = hashed.select("_doc", F.explode(doc.positions()).alias("p")).select("_doc", "p.*")
    several = positions.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fingerprint")
    met = positions.join(several, "fingerprint").groupBy("_doc").agg(F.collect_list("pos").alias("_met"))
    exploded = hashed.join(met, "_doc").select("_id", "_hash", "_lines", F.explode(doc.units(F.col("_met"))).alias("u"))
    side = window - 1
    first = F.greatest(F.lit(0), F.col("u.start") - side)
    last = F.col("u.start") + F.col("u.length")  # first line after the unit
    return exploded.select(
        "_id", "_hash", "u.content", "u.length", "u.start",
        # nearest first on both sides
        F.reverse(F.transform(F.slice("_lines", first + 1, F.col("u.start") - first), lambda x: x["h"]["a"])).alias("before"),
        F.transform(F.slice("_lines", last + 1, side), lambda x: x["h"]["a"]).alias("after"),
    )


def _agreeing(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.when(F.size(same) == 0, 0).otherwise(
        F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")
    )


def repeated_runs(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """(_id, _hash, _cut): documents that hold later runs, and the lines in them (sorted, from 0)."""
    from linesets.llm._common import materialize, result, scratch

    spark = docs.sparkSession
    with scratch(spark):
        hashed = materialize(_hashed(docs, text, id_col, window, long_words), "line-hashes")
        units = materialize(_units(hashed, window, long_words), "line-units")
        key = ["content", "length"]
        # the first position of each unit, combined before the shuffle: one with a third of the rows is one row a task
        place = F.struct(F.col("_id"), F.col("_hash"), F.col("start"))
        firsts = units.groupBy(*key).agg(F.min(F.struct(place.alias("place"), "before", "after")).alias("first"), F.count(F.lit(1)).alias("n"))
        # a table of its own, so that the join below can split a unit that very many documents have
        firsts = materialize(firsts.filter("n > 1").drop("n"), "line-firsts")
        later = units.join(firsts.hint("merge"), key).filter(place > F.col("first.place"))
        low = F.col("start") - _agreeing(F.col("before"), F.col("first.before"))
        high = F.col("start") + F.col("length") + _agreeing(F.col("after"), F.col("first.after")) - 1
        cut = later.select("_id", "_hash", F.explode(F.sequence(low, high)).alias("_pos"))
        cuts = cut.groupBy("_id", "_hash").agg(F.sort_array(F.collect_set("_pos")).alias("_cut"))
        path = result(cuts, "line-cuts")
    return spark.read.schema(cuts.schema).parquet(path)


#: Columns that dedup_lines adds; columns of these names in the input are replaced.
N_LINES, N_CUT = "line_dedup_lines", "line_dedup_cut"


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """docs with later repeated runs cut from the text, and how many lines it had and lost."""
    cuts = repeated_runs(docs, text, id_col, window, long_words)
    rest = [c for c in docs.columns if c not in (text, N_LINES, N_CUT)]
    # the row travels as one column, so that no name of the input can clash
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    own = docs.select(whole.alias("row"), F.col(text).alias("body"), F.col(id_col).alias("own_id"), F.xxhash64(text).alias("own_hash"))
    # the texts are dealt by id at every size; a join that splits skewed ids
    joined = own.join(cuts.hint("merge"), own["own_id"].eqNullSafe(cuts["_id"]) & (own["own_hash"] == cuts["_hash"]), "left")
    lines = F.split("body", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col("_cut"), i)), "\n")
    added = {
        text: F.when(F.col("_cut").isNull(), F.col("body")).otherwise(kept),
        N_LINES: F.when(F.octet_length("body") > 0, F.size(lines)).otherwise(0).cast("bigint"),
        N_CUT: F.coalesce(F.size("_cut"), F.lit(0)).cast("bigint"),
    }
    place = {c: F.col(f"row.c{i}") for i, c in enumerate(rest)} | added
    order = [c for c in docs.columns if c not in (N_LINES, N_CUT)] + [N_LINES, N_CUT]
    return joined.select(*[place[c].alias(c) for c in order])


def query(spark, sf_dir: str) -> DataFrame:
    from linesets.llm._common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.col(N_LINES).alias("n_lines"), F.col(N_CUT).alias("n_cut"), F.col("text").alias("kept_text"))


SQL = rf"""
with l as (
    select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
    from documents where octet_length(encode(text)) > 0),
lw as (select *, len(regexp_extract_all(line, '[^ \t-\r]+')) as words from l),
w as (
    select *, lead(words, 1) over o as words1,
        lead(line, 1) over o as l1, lead(line, 2) over o as l2, lag(line, 1) over o as b1, lag(line, 2) over o as b2,
        lead(line, 3) over o as l3, lead(line, 4) over o as l4
    from lw window o as (partition by doc_id order by pos)),
u as (
    select 'w' as kind, [line, l1, l2] as content, doc_id, pos, 3 as n, [b1, b2] as bs, [l3, l4] as afs from w where l2 is not null
    union all
    select 'p', [line, l1], doc_id, pos, 2, [b1, b2], [l2, l3] from w
    where greatest(words, words1) < {LONG_WORDS} and words + words1 >= {LONG_WORDS}
    union all
    select 'l', [line], doc_id, pos, 1, [b1, b2], [l1, l2] from w where words >= {LONG_WORDS}),
f as (
    select *, first_value(doc_id) over k as fd, first_value(pos) over k as fp, first_value(bs) over k as fb, first_value(afs) over k as fa
    from u window k as (partition by kind, content order by doc_id, pos)),
m as (
    select doc_id,
        pos - (case when bs[1] = fb[1] then 1 + (case when bs[2] = fb[2] then 1 else 0 end) else 0 end) as low,
        pos + n - 1 + (case when afs[1] = fa[1] then 1 + (case when afs[2] = fa[2] then 1 else 0 end) else 0 end) as high
    from f where doc_id <> fd or pos <> fp),
c as (select distinct doc_id, unnest(range(low, high + 1)) as pos from m),
k as (
    select l.doc_id, count(*) as n_lines, count(c.pos) as n_cut,
        coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where c.pos is null), '') as kept_text
    from l left join c on l.doc_id = c.doc_id and l.pos = c.pos group by l.doc_id)
select d.doc_id, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_cut, 0) as n_cut, coalesce(k.kept_text, d.text) as kept_text
from documents d left join k on d.doc_id = k.doc_id
"""
assert WINDOW == 3  # the SQL spells its windows out
