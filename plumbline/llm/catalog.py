"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "q01_suffix_dedup", "q02_decontaminate", "q03_url_filter", "q04_jaccard_join", "q05_passage_dedup",
    "q06_language_id", "q07_token_file", "q08_bpe", "q09_quality", "q10_license_scan",
    "q11_importance", "q12_toxicity", "q13_divergence",
)


def _modules():
    return [import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict:
    return {m.NAME: m.SQL for m in _modules() if m.SQL}
