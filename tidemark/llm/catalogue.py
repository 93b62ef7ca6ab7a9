"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm import chat
from tidemark.llm.chat import op6_chat_formatting
from tidemark.llm.decontaminate import op1_benchmark_decontamination
from tidemark.llm.fingerprint import op4_document_fingerprints
from tidemark.llm.html_text import op9_html_extraction
from tidemark.llm.language_model import op3_lm_scoring
from tidemark.llm.mixing import op7_mixing_to_target_weights
from tidemark.llm.quality import op8_quality_classifier
from tidemark.llm.secrets import op10_secret_scan
from tidemark.llm.simhash_dedup import op5_simhash_near_dedup
from tidemark.llm.token_output import op2_token_id_output

QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_token_id_output": op2_token_id_output,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_mixing_to_target_weights": op7_mixing_to_target_weights,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_html_extraction": op9_html_extraction,
    "op10_secret_scan": op10_secret_scan,
}

SQL: dict[str, str] = {
    "op6_chat_formatting": chat.SQL,
}
