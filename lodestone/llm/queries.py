"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, exact_dedup, language_id, minhash_dedup, mixing, quality, run_detection, secrets, substring_dedup, token_output, url_filter, vector_codes

QUERIES = {
    "op1_url_filter": url_filter.query,
    "url_filter_linked": url_filter.linked_query,
    "op2_secrets": secrets.query,
    "op3_language_id": language_id.query,
    "op4_minhash_dedup": minhash_dedup.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_chat_format": chat_format.query,
    "chat_format_events": chat_format.events_query,
    "op7_mixing": mixing.query,
    "op10_token_output": token_output.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_decontaminate": decontaminate.query,
    "op11_quality": quality.query,
    "op12_vector_codes": vector_codes.query,
    "op13_run_detection": run_detection.query,
}
SQL = {
    "op1_url_filter": url_filter.SQL,
    "url_filter_linked": url_filter.LINKED_SQL,
    "op2_secrets": secrets.SQL,
    "op4_minhash_dedup": minhash_dedup.SQL,
    "op6_chat_format": chat_format.SQL,
    "chat_format_events": chat_format.EVENTS_SQL,
    "op7_mixing": mixing.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op12_vector_codes": vector_codes.SQL,
}
