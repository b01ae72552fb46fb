"""Registry of this package's queries and their DuckDB oracles."""

from __future__ import annotations

from lodestar.llm import decontamination, exact_dedup, html_text, mixing, ngram_join, pii, quality, substring_dedup, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_decontamination": decontamination.op3_decontamination,
        "op4_pii": pii.op4_pii,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_quality": quality.op7_quality,
        "op8_html": html_text.op8_html,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict:
    return {"op1_ngram_join": ngram_join.ORACLE, "op3_decontamination": decontamination.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op10_mixing": mixing.ORACLE}
