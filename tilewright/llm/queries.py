"""The queries of this package and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tilewright.llm import chat, decontaminate, language_id, language_model, mixing, near, pages, quality, resampling, secrets, toxicity, urls, whitening


def queries() -> dict:
    return {
        "op1_lm_score": language_model.op1_lm_score,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_format_chats": chat.op3_format_chats,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_extract_html": pages.op5_extract_html,
        "op6_mix_sources": mixing.op6_mix_sources,
        "op7_near_duplicates": near.op7_near_duplicates,
        "op8_scan_secrets": secrets.op8_scan_secrets,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_url_templates": urls.op10_url_templates,
        "op11_language_id": language_id.op11_language_id,
        "op12_whitening": whitening.op12_whitening,
        "op13_resampling": resampling.op13_resampling,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_format_chats": chat.OP3_SQL,
        "op2_quality_rules": quality.OP2_SQL,
        "op4_decontaminate": decontaminate.OP4_SQL,
        "op6_mix_sources": mixing.OP6_SQL,
        "op7_near_duplicates": near.OP7_SQL,
        "op13_resampling": resampling.OP13_SQL,
    }
