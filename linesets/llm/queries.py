"""Queries of this subpackage, one opN_<name> for each operator, with SQL where it can express one."""

from __future__ import annotations

from linesets.llm import bpe, language_id, licenses, line_dedup, merkle, ngram_join, ngram_lm, packing, passages, shard_tree, va_search

QUERIES = {
    "op1_va_search": va_search.query,
    "op2_merkle_fingerprint": merkle.query,
    "op3_ngram_join": ngram_join.query,
    "op4_best_fit_packing": packing.query,
    "op5_language_id": language_id.query,
    "op6_shard_tree": shard_tree.query,
    "op7_line_dedup": line_dedup.query,
    "op7_passage_dedup": passages.query,
    "op8_kneser_ney": ngram_lm.query,
    "op9_bpe": bpe.query,
    "op10_license_scan": licenses.query,
}



def _columns(query, names: list[str]):
    return lambda spark, sf_dir: query(spark, sf_dir).select(*names)


# Columns of the queries above that SQL can express where it can't express all of them.
QUERIES |= {
    "columns_op2_edits": _columns(merkle.query, ["doc_id", "n_chars", "edited_sha256"]),
    "columns_op6_sizes": _columns(shard_tree.query, ["doc_id", "size", "law"]),
    "columns_op8_counts": _columns(ngram_lm.query, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]),
    "columns_op10_base": _columns(licenses.query, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]),
}

ORACLE = {
    "op1_va_search": va_search.SQL,
    "op3_ngram_join": ngram_join.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "columns_op2_edits": merkle.EDIT_SQL,
    "columns_op6_sizes": shard_tree.SIZE_SQL,
    "columns_op8_counts": ngram_lm.COUNT_SQL,
    "columns_op10_base": licenses.BASE_SQL,
}
