"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from strideframe.llm import oracles
from strideframe.llm.bpe import op1_bpe
from strideframe.llm.decontaminate import op7_decontaminate
from strideframe.llm.langid import op9_language
from strideframe.llm.licenses import op2_licenses
from strideframe.llm.pii import op3_pii
from strideframe.llm.quality import op5_quality
from strideframe.llm.simhash import op6_simhash
from strideframe.llm.substrings import op8_substrings
from strideframe.llm.suffix_array import op4_suffix_array
from strideframe.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_licenses": op2_licenses,
    "op3_pii": op3_pii,
    "op4_suffix_array": op4_suffix_array,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_decontaminate": op7_decontaminate,
    "op8_substrings": op8_substrings,
    "op9_language": op9_language,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = oracles.SQL
