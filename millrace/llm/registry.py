"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from millrace.llm.bpe import op8_bpe
from millrace.llm.decontamination import op5_decontamination
from millrace.llm.language import op6_language
from millrace.llm.licenses import op3_licenses
from millrace.llm.line_dedup import op2_line_dedup
from millrace.llm.near_duplicates import op9_ngram_jaccard
from millrace.llm.quality_classifier import op7_quality
from millrace.llm.quality_rules import op1_quality_rules
from millrace.llm.sql import ORACLE_SQL
from millrace.llm.token_counts import op4_token_counts
from millrace.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_line_dedup": op2_line_dedup,
    "op3_licenses": op3_licenses,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_language": op6_language,
    "op7_quality": op7_quality,
    "op8_bpe": op8_bpe,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_toxicity": op10_toxicity,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
