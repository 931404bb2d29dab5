"""The registered query of each operator, and DuckDB SQL where SQL can express it."""

from metrolith.llm import op01_line_dedup, op02_decontamination, op03_quality, op04_simhash, op05_repeats, op06_winnowing, op07_url_filter, op08_licenses, op09_pii, op10_packing

QUERIES = {
    "op1_line_dedup": op01_line_dedup.op1_line_dedup,
    "op2_decontamination": op02_decontamination.op2_decontamination,
    "op3_quality_classifier": op03_quality.op3_quality_classifier,
    "op4_simhash_near_dedup": op04_simhash.op4_simhash_near_dedup,
    "op5_repeat_removal": op05_repeats.op5_repeat_removal,
    "op6_winnowing_fingerprints": op06_winnowing.op6_winnowing_fingerprints,
    "op7_url_filter": op07_url_filter.op7_url_filter,
    "op8_license_scan": op08_licenses.op8_license_scan,
    "op9_pii": op09_pii.op9_pii,
    "op10_harmonic_packing": op10_packing.op10_harmonic_packing,
}

ORACLES = {
    "op1_line_dedup": op01_line_dedup.ORACLE,
    "op2_decontamination": op02_decontamination.ORACLE,
    "op8_license_scan": op08_licenses.ORACLE,
}
