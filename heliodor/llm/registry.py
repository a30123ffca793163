"""The queries of the training-data operators, and the SQL of those that have one."""

from __future__ import annotations

import importlib

#: Query name -> module that holds a function of that name, and ORACLE_SQL where SQL can express it.
MODULES = {
    "op1_token_files": "tokenfile",
    "op2_chat_format": "chat",
    "op3_language_id": "langid",
    "op4_suffix_dedup": "suffix",
    "op5_byte_bpe": "bpe",
    "op6_near_duplicates": "neardup",
    "op7_decontamination": "decontam",
    "op8_personal_data": "pii",
    "op9_substring_dedup": "substring",
    "op10_order_minhash": "fingerprint",
    "op11_merkle_manifest": "manifest",
    "op12_filter_audit": "audit",
    "op13_sentencepiece": "pieces",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"heliodor.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    modules = (importlib.import_module(f"heliodor.llm.{m}") for m in dict.fromkeys(MODULES.values()))
    return {k: v for m in modules for k, v in getattr(m, "ORACLE_SQL", {}).items()}
