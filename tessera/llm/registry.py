"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, exact_dedup, factorisation, line_dedup, mixing, packing, quality_rules, secret_scan, sharding, simhash

_MODULES = (quality_rules, factorisation, packing, line_dedup, sharding, chat_format, secret_scan, mixing, exact_dedup, simhash)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in getattr(m, "ORACLE", {}).items()}
