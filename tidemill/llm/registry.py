"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import centroids, chosen_path, decontaminate, exact_dedup, license_scan, maxent_lm, mixing, pii, resampling, spelling, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
    "op2_lm_scoring": maxent_lm.op2_lm_scoring,
    "op3_quality_classifier": resampling.op3_quality_classifier,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_url_filters": url_filter.op5_url_filters,
    "op6_pii": pii.op6_pii,
    "op7_suffix_array_dedup": substring_dedup.op7_suffix_array_dedup,
    "op8_license_scans": license_scan.op8_license_scans,
    "op9_ngram_jaccard_join": chosen_path.op9_ngram_jaccard_join,
    "op10_source_mixing": mixing.op10_source_mixing,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
}

#: Where SQL can express a query on whole tables; the others are tested against brute force.
ORACLES = {
    "op4_exact_dedup": exact_dedup.ORACLE_OP4,
    "op5_url_filters": url_filter.ORACLE_OP5,
    "op7_suffix_array_dedup": substring_dedup.ORACLE_OP7,
    "op8_license_scans": license_scan.ORACLE_OP8,
    "op9_ngram_jaccard_join": chosen_path.ORACLE_OP9,
    "op10_source_mixing": mixing.ORACLE_OP10,
    "op11_spelling_variants": spelling.ORACLE_OP11,
    "op13_centroid_clustering": centroids.ORACLE_OP13,
}
