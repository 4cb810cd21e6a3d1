"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from . import bpe, language_id, mixing, pii, quality_classifier, quality_rules, simhash, suffix_dedup, token_files, topk_search

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_language_id": language_id.query,
    "op4_token_files": token_files.query,
    "op5_simhash": simhash.query,
    "op6_topk_search": topk_search.query,
    "op7_quality_classifier": quality_classifier.query,
    "op8_quality_rules": quality_rules.query,
    "op9_byte_bpe": bpe.query,
    "op10_pii": pii.query,
}
ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op6_topk_search": topk_search.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
}
