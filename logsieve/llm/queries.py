"""The registered queries of this subpackage: opN_<name> applies operator N, with its
production parameters, to the whole of its table; ORACLE has DuckDB SQL where SQL can
express the result (the others are tested against brute-force versions)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logsieve.llm import (ann, bpe, collocations, exact_dedup, filter_audit, ngram_join, packing, quality_rules,
                          secret_scan, substring_dedup, token_counts, toxicity, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_packing": packing.op2_packing,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_bpe": bpe.op4_bpe,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_nearest": ann.op9_nearest,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_quality_rules": quality_rules.op11_quality_rules,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE: dict[str, str] = {
    "op1_url_filter": url_filter.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op11_quality_rules": quality_rules.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_collocations": collocations.SQL,
}
