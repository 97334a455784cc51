"""The queries of this folder and the SQL that some of them can be held against."""

from __future__ import annotations

from . import decontamination, licenses, lines, lm, packing, quality, simhash, suffix_dedup, token_counts, warc

QUERIES = {
    "op3_benchmark_decontamination": decontamination.op3_benchmark_decontamination,
    "op4_license_scans": licenses.op4_license_scans,
    "op5_line_dedup": lines.op5_line_dedup,
    "op7_warc": warc.op7_warc,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_lm_scoring": lm.op9_lm_scoring,
    "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op6_quality_rules": quality.op6_quality_rules,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_benchmark_decontamination": decontamination.ORACLE,
    "op7_warc": warc.ORACLE,
}
