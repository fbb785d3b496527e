"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from keepwell.llm import bpe, chat, conversation_trie, decontamination, exact_dedup, fim, jaccard, mixing, pii, ppm, quality_classifier, quality_rules, url_rules

QUERIES = {
    "op1_pii": pii.query,
    "op2_quality_rules": quality_rules.query,
    "op3_lm_scoring": ppm.query,
    "op4_ngram_jaccard": jaccard.query,
    "op5_quality_classifier": quality_classifier.query,
    "op6_url_filters": url_rules.query,
    "op7_mixing": mixing.query,
    "op8_chat": chat.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_bpe": bpe.query,
    "op11_conversation_trie": conversation_trie.query,
    "op12_fim": fim.query,
    "op13_decontamination": decontamination.query,
}

ORACLE_SQL = {
    "op1_pii": pii.SQL,
    "op6_url_filters": url_rules.SQL,
    "op8_chat": chat.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op11_conversation_trie": conversation_trie.SQL,
    "op12_fim": fim.SQL,
    "op13_decontamination": decontamination.SQL,
}
