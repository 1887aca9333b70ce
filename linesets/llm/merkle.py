"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

A text is its paragraphs (lines); a paragraph is cut into pieces where its content says so:
behind a word whose last code point is `BORDER` modulo `EVERY`, after `PIECE` code points at
the latest, so words that are inserted or removed don't move the borders of later pieces. Paragraphs form sections: a section ends after a
paragraph whose hash is 0 modulo `SECTION`, so that inserted paragraphs
don't move the borders of later sections. The hash of a node covers the hashes of
its children, and the root covers the sections and the text's length.

Equal texts have equal roots. Trees are compared from the root: equal hashes end
a branch at once, and only differing branches are opened, which locates an edit
in sections, paragraphs and pieces (diff). The likeness of two fingerprints is the
share of code points in pieces that both have, counted as often as both have them:
2 * shared / (length of one + length of the other); 1 for equal roots.

The fingerprint is a string: the root and, for each section, its paragraphs with
their pieces as (hash, length). All of the tree can be rebuilt from it.

Null texts are empty; two empty texts are equal; an empty table gives no rows. Texts are
read whole, however long, and only id and text are read, so others may have any name. In the query the next document
is the one with the next smaller doc_id (null ids come last); rows with equal
ids are taken in the order of their texts. After the last comes the first.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linesets.llm._common import table, tidy, with_workers

#: A piece ends behind a word whose last code point is BORDER modulo EVERY, at most PIECE code points long.
BORDER, EVERY, PIECE = 3, 8, 256
SECTION = 4
#: Bytes of text that one range of ids holds, about.
RANGE_BYTES = 4 << 20
#: From so many ranges on both their number and their size grow; a range is walked row by row, so its size needs no memory.
WIDE = 4096
#: Ids are counted in at most 2^13 cells; a cell with too many is counted anew in 2^4.
CELLS, FINER_BITS = 1 << 13, 4

_BORDERS = "".join(re.escape(chr(c)) for c in range(0x10000) if c % EVERY == BORDER and not 0xD800 <= c < 0xE000)
_pieces = re.compile(f".{{0,{PIECE - 2}}}?[{_BORDERS}] |.{{1,{PIECE}}}", re.DOTALL)


@dataclass(frozen=True)
class Paragraph:
    hash: int
    pieces: tuple[tuple[int, int], ...]  # (hash, code points)


@dataclass(frozen=True)
class Section:
    hash: int
    paragraphs: tuple[Paragraph, ...]


@dataclass(frozen=True)
class Tree:
    root: str
    sections: tuple[Section, ...]


def _join(hashes) -> int:
    return xxhash.xxh64_intdigest(b"".join([h.to_bytes(8, "little") for h in hashes]))


def _paragraph(text: str) -> Paragraph:
    cut = _pieces.findall(text) or [""]
    pieces = tuple([(xxhash.xxh64_intdigest(p.encode()), len(p)) for p in cut])
    return Paragraph(_join([h for h, _ in pieces]), pieces)


def _tree(paragraphs: list[Paragraph], digest: str) -> Tree:
    sections, part = [], []
    for p in paragraphs:
        part.append(p)
        if p.hash % SECTION == 0:
            sections.append(Section(_join([x.hash for x in part]), tuple(part)))
            part = []
    if part:
        sections.append(Section(_join([x.hash for x in part]), tuple(part)))
    top = sha256(b"".join([s.hash.to_bytes(8, "little") for s in sections]) + digest.encode())
    return Tree(top.hexdigest()[:32], tuple(sections))


def build(text: str | None) -> Tree:
    """The root also covers the whole text's digest, so equal roots mean equal texts."""
    text = text or ""
    return _tree([_paragraph(p) for p in text.split("\n")], sha256(text.encode()).hexdigest())


def show(tree: Tree) -> str:
    """root|paragraph;paragraph/paragraph..: sections between /, pieces as hash-length between commas."""
    return tree.root + "|" + "/".join([";".join([",".join([f"{h:x}-{n:x}" for h, n in p.pieces]) for p in s.paragraphs]) for s in tree.sections])


def parse(fingerprint: str) -> Tree:
    root, _, rest = fingerprint.partition("|")
    sections = []
    for s in rest.split("/"):
        paragraphs = []
        for p in s.split(";"):
            pieces = tuple((int(h, 16), int(n, 16)) for h, n in (x.split("-") for x in p.split(",")))
            paragraphs.append(Paragraph(_join([h for h, _ in pieces]), pieces))
        sections.append(Section(_join([p.hash for p in paragraphs]), tuple(paragraphs)))
    return Tree(root, tuple(sections))


def _unmatched(ours: list, theirs: list) -> tuple[list, list]:
    """Nodes of each side whose hash the other side doesn't have as often."""
    left, right = Counter(n.hash for n in ours), Counter(n.hash for n in theirs)
    both = left & right
    out = []
    for nodes in (ours, theirs):
        spare, rest = Counter(both), []
        for n in nodes:
            if spare[n.hash]:
                spare[n.hash] -= 1
            else:
                rest.append(n)
        out.append(rest)
    return out[0], out[1]


def length(tree: Tree) -> int:
    return sum(n for s in tree.sections for p in s.paragraphs for _, n in p.pieces)


def likeness(a: Tree, b: Tree) -> float:
    """Share of code points in common pieces; opens only branches whose hashes differ."""
    if a.root == b.root:
        return 1.0
    total = length(a) + length(b)
    if not total:
        return 1.0
    ours, theirs = _unmatched(list(a.sections), list(b.sections))
    p, q = _unmatched([x for s in ours for x in s.paragraphs], [x for s in theirs for x in s.paragraphs])
    left, right = Counter(x for n in p for x in n.pieces), Counter(x for n in q for x in n.pieces)
    # what stays unmatched on both sides is the difference
    apart = sum(n * c for (_, n), c in ((left - right) + (right - left)).items())
    return (total - apart) / total


def diff(a: Tree, b: Tree) -> list[tuple[int, int, int]]:
    """(section, paragraph, piece) of a, each from 0, that b lacks in its differing branches."""
    if a.root == b.root:
        return []
    ours, theirs = _unmatched(list(a.sections), list(b.sections))
    ids = {id(s) for s in ours}
    _, q = _unmatched([x for s in ours for x in s.paragraphs], [x for s in theirs for x in s.paragraphs])
    have = Counter(x for n in q for x in n.pieces)
    known = Counter(x.hash for s in theirs for x in s.paragraphs)
    out = []
    for i, s in enumerate(a.sections):
        if id(s) not in ids:
            continue
        for j, p in enumerate(s.paragraphs):
            if known[p.hash]:
                known[p.hash] -= 1
                continue
            for k, x in enumerate(p.pieces):
                if have[x]:
                    have[x] -= 1
                else:
                    out.append((i, j, k))
    return out


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the start of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


class _Built:
    """A text with its tree; an edited text takes over the paragraphs before the edit."""

    def __init__(self, text: str):
        self.text = text
        self.paragraphs = [_paragraph(p) for p in text.split("\n")]
        self.tree = _tree(self.paragraphs, sha256(text.encode()).hexdigest())

    def edited(self, following: str) -> tuple[str, Tree]:
        new = edited(self.text, following)
        kept = self.text[: len(self.text) - len(self.text) // 2]
        whole = kept.count("\n")
        rest = new[kept.rfind("\n") + 1 :]
        digest = sha256(new.encode()).hexdigest()
        return digest, _tree(self.paragraphs[:whole] + [_paragraph(p) for p in rest.split("\n")], digest)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, guest, id descending, text); a guest is only the next document of the row before it."""
    before: tuple | None = None  # (range, id, built) that waits for its next document
    for batch in batches:
        rows: list[tuple] = []
        for span, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            built = _Built(text)
            if before is not None and before[0] == span:
                _, own_id, own = before
                digest, tree = own.edited(text)
                rows.append((own_id, len(own.text), digest, show(own.tree), show(tree), likeness(own.tree, tree), likeness(own.tree, built.tree)))
            before = None if guest else (span, doc_id, built)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(SCHEMA)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=SCHEMA.names)


def range_borders(ids: DataFrame, n_ranges: int) -> list[int]:
    """Ids that begin a new range: fewer than n_ranges, with about as many rows between any two.

    ids has doc_id without nulls. They are counted by their leading bits, combined
    before the shuffle, and cells that hold more than a range should are counted by
    more bits, so ids may lie as unevenly as they like. There are fewer than n_ranges such cells,
    which bounds the counts that come to the driver.
    """
    low, high, total = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    if not total or n_ranges < 2:
        return []
    share, shift = -(-total // n_ranges), 0
    while (high >> shift) - (low >> shift) >= CELLS:
        shift += 1
    cells: list[tuple[int, int]] = []  # first id, rows
    rows = ids
    while True:
        found = rows.groupBy(F.shiftright("doc_id", shift).alias("cell")).agg(F.count("doc_id").alias("n")).collect()
        heavy = [r["cell"] for r in found if r["n"] > share and shift]
        cells += [(r["cell"] << shift, r["n"]) for r in found if r["n"] <= share or not shift]
        if not heavy:
            break
        rows = ids.filter(F.shiftright("doc_id", shift).isin(heavy))
        shift = max(0, shift - FINER_BITS)
    borders, held = [], 0
    for first, n in sorted(cells):
        if held >= share:
            borders.append(first)
            held = 0
        held += n
    return borders


def borders_up_to(borders: list[int], value: Column) -> Column:
    """How many of the sorted borders aren't above a value, by halving: as many steps as the number of borders has bits."""
    sorted_ = F.from_json(F.lit(json.dumps(borders)), "array<bigint>")  # one literal, however many there are
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(borders).bit_length()))]).cast("array<int>")
    passed = lambda at, step: (at + step <= len(borders)) & (F.get(sorted_, at + step - 1) <= value)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(passed(at, step), at + step).otherwise(at))


def with_next(docs: DataFrame, n_ranges: int) -> DataFrame:
    """(span, guest, doc_id, text): documents dealt to ranges of ids, each followed by a copy of the document after it.

    Ranges hold about as many documents each; the texts move once.
    """
    spark = docs.sparkSession
    borders = range_borders(docs.filter("doc_id is not null").select("doc_id"), n_ranges)
    # the range of an id is the number of borders that aren't above it; null ids are below all
    spans = docs.withColumn("span", F.when(F.col("doc_id").isNull(), 0).otherwise(borders_up_to(borders, F.col("doc_id"))))
    # the first document of each range, of the ranges that have one, in descending order
    firsts = [(r["span"], r["id"]) for r in spans.groupBy("span").agg(F.max("doc_id").alias("id")).orderBy(F.desc("span")).collect()]
    guests = [(firsts[(i + 1) % len(firsts)], span) for i, (span, _) in enumerate(firsts)]
    if not guests:
        return spans.select("span", F.lit(False).alias("guest"), "doc_id", "text")
    visits = spark.createDataFrame([(s, i, to) for (s, i), to in guests], "span int, doc_id bigint, to int")
    # at most two rows a range, so the side is bounded by n_ranges
    same = [spans["span"] == visits["span"], spans["doc_id"].eqNullSafe(visits["doc_id"])]
    targets = spans.join(F.broadcast(visits), same, "left")
    dealt = F.when(visits["to"].isNull(), F.array(F.struct(spans["span"].alias("span"), F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct(spans["span"].alias("span"), F.lit(False).alias("guest")), F.struct(visits["to"].alias("span"), F.lit(True).alias("guest")))
    )
    return targets.select(F.explode(dealt).alias("at"), spans["doc_id"], spans["text"]).select("at.span", "at.guest", "doc_id", "text")


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint) of every document: no shuffle."""
    with_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [show(build(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(tidy(run), "doc_id bigint, fingerprint string")


def compare_next(docs: DataFrame, text: str = "text", id_col: str = "doc_id", range_bytes: int = RANGE_BYTES) -> DataFrame:
    with_workers(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units = -(-size // range_bytes)
    n = max(1, units if units <= WIDE else math.isqrt(WIDE * units))
    rows = with_next(slim, n).repartitionByRange(n, "span")
    return rows.sortWithinPartitions("span", "guest", F.desc_nulls_last("doc_id"), "text").mapInArrow(tidy(_walk), SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return compare_next(table(spark, sf_dir, "documents"))


#: The columns that no fingerprint enters.
EDIT_SQL = """
with d as (select doc_id, coalesce(text, '') as text from documents),
n as (select doc_id, text, coalesce(lead(text) over (order by doc_id desc), first_value(text) over (order by doc_id desc)) as following from d)
select doc_id, length(text)::bigint as n_chars,
    sha256(left(text, length(text) - length(text) // 2) || left(following, length(text) // 2)) as edited_sha256
from n
"""
