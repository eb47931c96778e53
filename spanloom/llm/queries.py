"""The queries over the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from spanloom.llm import byte_bpe, centroid_clustering, chat_formatting, language_id, media_columns, near_dedup, packing, quality_classifier, quality_rules, secret_scans, spelling_variants, substring_dedup, url_filters

QUERIES = {
    "op1_packing": packing.op1,
    "op2_substring_dedup": substring_dedup.op2,
    "op3_url_filters": url_filters.op3,
    "op4_quality_classifier": quality_classifier.op4,
    "op6_language_id": language_id.op6,
    "op5_near_dedup": near_dedup.op5,
    "op7_secret_scans": secret_scans.op7,
    "op8_media_columns": media_columns.op8,
    "op9_byte_bpe": byte_bpe.op9,
    "op10_quality_rules": quality_rules.op10,
    "op11_centroid_clustering": centroid_clustering.op11,
    "op12_spelling_variants": spelling_variants.op12,
    "op13_chat_formatting": chat_formatting.op13,
}
ORACLES: dict[str, str] = {
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op3_url_filters": url_filters.ORACLE,
    "op5_near_dedup": near_dedup.ORACLE,
    "op7_secret_scans": secret_scans.ORACLE,
    "op11_centroid_clustering": centroid_clustering.ORACLE,
    "op12_spelling_variants": spelling_variants.ORACLE,
    "op13_chat_formatting": chat_formatting.ORACLE,
}
