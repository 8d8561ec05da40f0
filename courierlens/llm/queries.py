"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from courierlens.llm import (
    chat_format, decontamination, hamming_join, license_scan, line_dedup, ngram_jaccard, quality_rules, sentencepiece_codec, spelling, substring_dedup, token_counts,
    toxicity, whitening,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_ngram_jaccard": ngram_jaccard.op3_ngram_jaccard,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_preference_format": chat_format.op6_preference_format,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_sentencepiece": sentencepiece_codec.op10_sentencepiece,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_hamming_join": hamming_join.op12_hamming_join,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL = {
    "op5_quality_rules": quality_rules.OP5_SQL,
    "op6_preference_format": chat_format.OP6_SQL,
}
