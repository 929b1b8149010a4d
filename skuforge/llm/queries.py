"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, conversation_trie, exact_dedup, impact_search, line_chunks, periodic_runs, pfair_mixing, pii, sharding, simhash, token_counts, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pfair_mixing": pfair_mixing.op1_pfair_mixing,
        "op2_pii_surrogates": pii.op2_pii_surrogates,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_impact_search": impact_search.op4_impact_search,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_warc": warc.op6_warc,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_byte_bpe": byte_bpe.op8_byte_bpe,
        "op9_simhash": simhash.op9_simhash,
        "op10_line_chunks": line_chunks.op10_line_chunks,
        "op11_jump_sharding": sharding.op11_jump_sharding,
        "op12_conversation_trie": conversation_trie.op12_conversation_trie,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pfair_mixing": pfair_mixing.ORACLE,
        "op4_impact_search": impact_search.ORACLE,
        "op5_exact_dedup": exact_dedup.ORACLE,
        "op11_jump_sharding": sharding.ORACLE,
        "op12_conversation_trie": conversation_trie.ORACLE,
        "op13_periodic_runs": periodic_runs.ORACLE,
    }
