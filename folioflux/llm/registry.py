"""Queries and SQL of the operators of this subpackage, by name."""

from __future__ import annotations

from folioflux.llm import decontamination, exact_dedup, filter_audit, html_extraction, language_id, license_scan, mixing, ngram_join, pii, secret_scan, token_alignment, toxicity, url_filter

QUERIES: dict = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_pii": pii.op2_pii,
    "op7_language_id": language_id.op7_language_id,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_mixing": mixing.op6_mixing,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_html_extraction": html_extraction.op13_html_extraction,
}

ORACLES: dict = {
    "op4_decontamination": decontamination.OP4_SQL,
    "op10_ngram_join": ngram_join.OP10_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}
