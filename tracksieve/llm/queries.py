"""The registered queries of this folder: name -> function, and name -> SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracksieve.llm import language_id, line_dedup, mixing, near_dedup, packing, prefix_trie, quality_rules, repeated_passages, sharding, token_counts, vector_codes, vector_search, weak_quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding.op1_sharding,
    "op2_vector_search": vector_search.op2_vector_search,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_language_id": language_id.op6_language_id,
    "op7_mixing": mixing.op7_mixing,
    "op8_repeated_passages": repeated_passages.op8_repeated_passages,
    "op9_weak_quality": weak_quality.op9_weak_quality,
    "op10_packing": packing.op10_packing,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
