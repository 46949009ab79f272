"""Registered queries of the training-data operators, and their DuckDB forms where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codebooks, cross_polytope, decontaminate, licenses, lm_scoring, mixing, ngram_quality, quality_rules, quotations, simhash, token_file, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_ngram_quality": ngram_quality.op3_ngram_quality,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_quotation_threads": quotations.op7_quotation_threads,
    "op8_token_ids": token_file.op8_token_ids,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    "op11_embedding_near_dedup": cross_polytope.op11_embedding_near_dedup,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_vector_codes": codebooks.op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op7_quotation_threads": quotations.ORACLE,
    "op11_embedding_near_dedup": cross_polytope.ORACLE,
    "op13_vector_codes": codebooks.ORACLE,
}
