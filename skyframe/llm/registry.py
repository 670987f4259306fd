"""Queries of this subpackage and their DuckDB SQL."""

from . import conversation_repair, decontamination, jaccard_join, pii_crf, quality, repetition, secret_scan, source_mix, substring_dedup, token_count, toxicity, weighted_sampling

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_ngram_jaccard_join": jaccard_join.op4_ngram_jaccard_join,
    "op5_repetition_rules": repetition.op5_repetition_rules,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_source_mix": source_mix.op8_source_mix,
    "op9_token_count": token_count.op9_token_count,
    "op10_pii_crf": pii_crf.op10_pii_crf,
    "op11_weighted_fingerprint": weighted_sampling.op11_weighted_fingerprint,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
}

ORACLES = {
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op4_ngram_jaccard_join": jaccard_join.ORACLE,
    "op8_source_mix": source_mix.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
}
