"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontam, langid, lm_score, media, mixing, near_dup, quality, secret_scan, spelling, suffix_dedup, token_files, whitening


def queries():
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_media_columns": media.op2_media_columns,
        "op3_secret_scan": secret_scan.op3_secret_scan,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_token_files": token_files.op5_token_files,
        "op6_chat_format": chat.op6_chat_format,
        "op7_decontaminate": decontam.op7_decontaminate,
        "op8_lm_score": lm_score.op8_lm_score,
        "op9_language_id": langid.op9_language_id,
        "op10_simhash": near_dup.op10_simhash,
        "op11_whitening": whitening.op11_whitening,
        "op12_quality_rules": quality.op12_quality_rules,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql():
    return {"op4_mix_sources": mixing.OP4_SQL, "op6_chat_format": chat.OP6_SQL, "op7_decontaminate": decontam.OP7_SQL, "op12_quality_rules": quality.OP12_SQL}
