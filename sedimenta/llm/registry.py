"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import content_sort, dart_minhash, decontaminate, lid_crf, line_dedup, ngram_trie, packing, prefix_trie, reply_trees, secret_scan, suffix_dedup, vector_codes, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lid_crf": lid_crf.op1_lid_crf,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_ngram_trie": ngram_trie.op4_ngram_trie,
    "op5_packing": packing.op5_packing,
    "op6_reply_trees": reply_trees.op6_reply_trees,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_dart_minhash": dart_minhash.op8_dart_minhash,
    "op9_content_sort": content_sort.op9_content_sort,
    "op10_warc": warc.op10_warc,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op6_reply_trees": reply_trees.OP6_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op9_content_sort": content_sort.OP9_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_line_dedup": line_dedup.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
