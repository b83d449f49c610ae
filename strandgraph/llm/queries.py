"""Queries of the subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, binary_output, bpe, collocations, decontamination, exact_dedup, language, line_dedup, ngram_jaccard, pii, sharding, suffix_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_bpe": bpe.op2_bpe,
        "op3_sharding": sharding.op3_sharding,
        "op4_decontamination": decontamination.op4_decontamination,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_ngram_jaccard": ngram_jaccard.op6_ngram_jaccard,
        "op7_pii": pii.op7_pii,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_language_id": language.op9_language_id,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_binary_output": binary_output.op11_binary_output,
        "op12_alignment": alignment.op12_alignment,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op3_sharding": sharding.ORACLE,
        "op4_decontamination": decontamination.ORACLE,
        "op6_ngram_jaccard": ngram_jaccard.ORACLE,
        "op13_collocations": collocations.ORACLE,
    }
