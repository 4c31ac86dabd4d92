"""Queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

#: Query name and the module that holds its ``query`` and, where SQL can
#: express it, its ``ORACLE_SQL``.
MODULES = {
    "op1_quality_rules": "quality",
    "op2_toxicity": "toxicity",
    "op3_token_files": "token_files",
    "op4_source_mix": "mixing",
    "op5_decontaminate": "decontaminate",
    "op6_token_counts": "separators",
    "op7_language_spans": "langid",
    "op8_license_scan": "licenses",
    "op9_chat_format": "chat",
    "op10_simhash": "simhash",
}


def queries() -> dict:
    return {name: import_module(f"{__package__}.{m}").query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{m}"), "ORACLE_SQL", None) for name, m in MODULES.items()}
    return {k: v for k, v in found.items() if v}
