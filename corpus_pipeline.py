"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as
Parquet to the shared folder and reads it back as the next stage's docs. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesets.llm import _tokens, language_id, line_dedup, ngram_join, packing
from linesets.llm._common import materialize, result, scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; lang becomes the prediction.

    Rejected: null texts and texts without a letter. A text in another language
    than its label stays, with the language it is in.
    """
    model = language_id.learn(docs)
    found = language_id.identify(docs, model).filter(F.col(language_id.LANG) != language_id.UNDETERMINED)
    return found.withColumn("lang", F.col(language_id.LANG)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stand earlier in the corpus.

    A document of which nothing but blanks is left goes; n_chars follows the text.
    """
    found = line_dedup.dedup_lines(docs)
    gone = (F.col(line_dedup.N_CUT) > 0) & ~F.col("text").rlike(r"\S")
    kept = found.filter(F.coalesce(~gone, F.lit(True)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(line_dedup.N_CUT) > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Rows that repeat its doc_id are its copies too: the least text stays. A row with
    a null id goes if its group has another id; of a group without any, one row
    stays. Documents without words are copies of nothing and stay.
    """
    groups = ngram_join.grouped(docs)
    mark, times = (f"_{n}_{uuid.uuid4().hex}" for n in ("kept", "times"))  # no column of docs has these names
    kept = groups.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(mark)).agg(F.count(F.lit(1)).alias(times))
    named = docs.join(kept, F.col("doc_id") == F.col(mark))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # the least text, then the least row as it is written out: columns needn't have an order
    least = F.min_by(F.struct(*columns), F.struct("text", F.to_json(F.struct(*columns)))).alias("_row")
    single = named.filter(F.col(times) == 1).select(*columns)
    chosen = named.filter(F.col(times) > 1).groupBy(mark).agg(least).select("_row.*")
    # rows with null ids are told by their texts
    nameless = groups.filter("doc_id is null")
    wordless = nameless.filter("component is null").select(F.col("hash").alias(mark)).distinct()
    lone = nameless.filter("component is not null and component_id is null").groupBy("component").agg(F.min("hash").alias(mark)).select(mark)
    null = docs.filter("doc_id is null")
    alike = F.xxhash64("text") == F.col(mark)
    first = null.join(lone, alike, "left_semi").groupBy(F.xxhash64("text").alias(times)).agg(least).select("_row.*")
    return single.unionByName(chosen).unionByName(null.join(wordless, alike, "left_semi")).unionByName(first).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset."""
    return packing.pack_documents(docs, _tokens.vocabulary_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("best_fit_packing", pack),
]

#: Language ID and packing are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):  # the stages' tables go when the last one's is written
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), name)
        last = STAGES[-1][1](spark, docs, sf_dir)
        path = result(last, "pipeline")
    return spark.read.schema(last.schema).parquet(path)
