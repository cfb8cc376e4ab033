"""The numbered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fim, jaccard_join, line_dedup, mixing, pieces, quality, search, simhash, suffix_dedup, token_counts, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_jaccard_join": jaccard_join.op3_jaccard_join,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_warc_derivatives": warc.op9_warc_derivatives,
        "op10_mixing": mixing.op10_mixing,
        "op11_simhash": simhash.op11_simhash,
        "op12_fim": fim.op12_fim,
        "op13_search": search.op13_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": line_dedup.SQL, "op7_exact_dedup": exact_dedup.SQL, "op10_mixing": mixing.SQL, "op12_fim": fim.SQL, "op13_search": search.SQL}
