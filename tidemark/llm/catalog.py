"""Queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from . import class_lm, conversations, decontaminate, exact_dedup, jaccard_join, license_scan, packing, quality, resampling, sharding, token_counts, token_store, toxicity

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_token_store": token_store.op5_token_store,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_class_lm": class_lm.op7_class_lm,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_sharding": sharding.op13_sharding,
}

ORACLES = {
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_conversation_repair": conversations.ORACLE,
    "op13_sharding": sharding.ORACLE,
}
