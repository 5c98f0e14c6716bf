"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from codexlake.llm import decontamination, html_text, jaccard, language, line_dedup, packing, quality, suffix_dedup, token_files, toxicity

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_packing": packing.op2_packing,
    "op3_html_text": html_text.op3_html_text,
    "op4_quality": quality.op4_quality,
    "op5_token_files": token_files.op5_token_files,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_language": language.op9_language,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
}

ORACLE: dict[str, str] = {
    "op1_decontamination": decontamination.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
}
