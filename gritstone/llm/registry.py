"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import audio, chat, decontaminate, language_id, mixing, near_duplicates, quality, repeats, secrets, token_files

QUERIES = {
    "op1_quality_ftrl": quality.op1,
    "op2_golden_ratio_mix": mixing.op2,
    "op3_secret_scan": secrets.op3,
    "op4_prob_minhash": near_duplicates.op4,
    "op5_repeated_passages": repeats.op5,
    "op6_chroma_fingerprints": audio.op6,
    "op7_winnow_decontamination": decontaminate.op7,
    "op8_chat_format": chat.op8,
    "op9_arrow_token_files": token_files.op9,
    "op10_language_id": language_id.op10,
}
ORACLES: dict[str, str] = {
    "op2_golden_ratio_mix": mixing.ORACLE,
    "op4_prob_minhash": near_duplicates.ORACLE,
    "op5_repeated_passages": repeats.ORACLE,
    "op7_winnow_decontamination": decontaminate.ORACLE,
    "op8_chat_format": chat.ORACLE,
}
