"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from vidspark.llm import (bpe, decontaminate, disclosure, html_text, language_model, licences, quality_rules, sharding, simhash,
                          suffix_dedup, token_files, vector_codes, whitening)

QUERIES = {
    "op1_html_text": html_text.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_quality_rules": quality_rules.query,
    "op4_licences": licences.query,
    "op5_decontaminate": decontaminate.query,
    "op6_bpe": bpe.query,
    "op7_language_model": language_model.query,
    "op8_sharding": sharding.query,
    "op9_simhash": simhash.query,
    "op10_token_files": token_files.query,
    "op11_disclosure": disclosure.query,
    "op12_whitening": whitening.query,
    "op13_vector_codes": vector_codes.query,
}
ORACLES = {
    "op3_quality_rules": quality_rules.SQL,
    "op4_licences": licences.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op11_disclosure": disclosure.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
