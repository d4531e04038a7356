"""The registered queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from lodemap.llm import bpe, decontaminate, divergence, hard_negatives, html_text, language, licenses, line_dedup, neighbours, quality, sharding, simhash, token_files

QUERIES = {
    "op1_nearest_neighbours": neighbours.op1_nearest_neighbours,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_token_files": token_files.op4_token_files,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_html_extraction": html_text.op7_html_extraction,
    "op8_language_id": language.op8_language_id,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_external_shuffle": sharding.op10_external_shuffle,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLES = {
    "op3_license_scan": licenses.oracle_sql(),
    "op11_line_dedup": line_dedup.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
