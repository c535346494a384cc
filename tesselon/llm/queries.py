"""The queries opN_<name> over whole tables and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from tesselon.llm import (
    decontamination,
    embedding_dedup,
    html_extraction,
    langid,
    line_dedup,
    minhash,
    packing,
    quality,
    substring_dedup,
    token_files,
)


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_language_id": langid.op2_language_id,
        "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
        "op4_minhash": minhash.op4_minhash,
        "op5_packing": packing.op5_packing,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_html_extraction": html_extraction.op8_html_extraction,
        "op9_token_files": token_files.op9_token_files,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.OP1_SQL,
        "op3_embedding_dedup": embedding_dedup.OP3_SQL,
        "op4_minhash": minhash.OP4_SQL,
        "op6_line_dedup": line_dedup.OP6_SQL,
        "op8_html_extraction": html_extraction.OP8_SQL,
    }
