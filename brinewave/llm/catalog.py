"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import op1_quality_rules, op2_quality_classifier, op3_mixing, op4_chat_format, op5_language_id, op6_decontaminate, op7_minhash_dedup, op8_warc, op9_toxicity, op10_license_scan

QUERIES = {
    "op1_quality_rules": op1_quality_rules.query,
    "op2_quality_classifier": op2_quality_classifier.query,
    "op3_mixing": op3_mixing.query,
    "op4_chat_format": op4_chat_format.query,
    "op5_language_id": op5_language_id.query,
    "op6_decontaminate": op6_decontaminate.query,
    "op7_minhash_dedup": op7_minhash_dedup.query,
    "op8_warc": op8_warc.query,
    "op9_toxicity": op9_toxicity.query,
    "op10_license_scan": op10_license_scan.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": op1_quality_rules.ORACLE_SQL,
    "op3_mixing": op3_mixing.ORACLE_SQL,
    "op6_decontaminate": op6_decontaminate.ORACLE_SQL,
    "op7_minhash_dedup": op7_minhash_dedup.ORACLE_SQL,
    "op8_warc": op8_warc.ORACLE_SQL,
    "op10_license_scan": op10_license_scan.ORACLE_SQL,
}
