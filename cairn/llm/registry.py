"""Queries and oracle SQL of this subpackage, for ``__spark_entry__``."""
from __future__ import annotations

from importlib import import_module

#: module: (query, attribute that holds its DuckDB SQL or None)
_QUERIES = {
    "op1_quality_rules": ("op1_quality_rules", "SQL"),
    "op2_html_extraction": ("op2_html_extraction", None),
    "op3_sharding": ("op3_sharding", None),
    "op5_media_columns": ("op5_media_columns", None),
    "op4_secret_scans": ("op4_secret_scans", None),
    "op6_ngram_jaccard_join": ("op6_ngram_jaccard_join", "SQL"),
    "op7_mixing": ("op7_mixing", "SQL"),
    "op8_quality_classifier": ("op8_quality_classifier", None),
    "op9_packing": ("op9_packing", None),
    "op10_lm_scoring": ("op10_lm_scoring", None),
}


def queries() -> dict:
    return {query: getattr(import_module(f"{__package__}.{module}"), query) for module, (query, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {query: getattr(import_module(f"{__package__}.{module}"), sql) for module, (query, sql) in _QUERIES.items() if sql}
