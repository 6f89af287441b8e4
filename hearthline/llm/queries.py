"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from hearthline.llm import byte_bpe, compress_quality, embedding_dedup, filter_audit, jaccard_join, language_id, license_scan, maxent_lm, mixing, oracles, quality_rules, secret_scan, sharding, source_divergence

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_license_scan": license_scan.query,
    "op3_minimax_shards": sharding.query,
    "op4_embedding_dedup": embedding_dedup.query,
    "op5_secret_scan": secret_scan.query,
    "op6_maxent_lm": maxent_lm.query,
    "op7_byte_bpe": byte_bpe.query,
    "op8_compression_quality": compress_quality.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_source_mix": mixing.query,
    "op11_source_divergence": source_divergence.query,
    "op12_language_id": language_id.query,
    "op13_filter_audit": filter_audit.query,
}
ORACLE_SQL: dict[str, str] = dict(oracles.ORACLE_SQL)
