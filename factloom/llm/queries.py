"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from factloom.llm import conversations, decontaminate, extract, jaccard, language, licences, lm, matroska, mixing, quality, runs, secrets, tokens

QUERIES = {
    "op1_secret_scan": secrets.query,
    "op2_quality_classifier": quality.query,
    "op3_token_counts": tokens.query,
    "op4_license_scan": licences.query,
    "op5_source_mix": mixing.query,
    "op6_matroska": matroska.query,
    "op7_bloom_lm": lm.query,
    "op8_jaccard_join": jaccard.query,
    "op9_language_id": language.query,
    "op10_decontamination": decontaminate.query,
    "op11_periodic_runs": runs.query,
    "op12_conversation_repair": conversations.query,
    "op13_html_extraction": extract.query,
    "decontamination_near": decontaminate.near_query,
}

SQL = {
    "op4_license_scan": licences.SQL,
    "op5_source_mix": mixing.SQL,
    "op10_decontamination": decontaminate.SQL,
}
