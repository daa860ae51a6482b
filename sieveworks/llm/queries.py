"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import q_binary_records, q_decontaminate, q_line_dedup, q_mixing, q_near_dedup, q_quality_rules, q_secret_scan, q_token_counts, q_url_filter, q_warc

MODULES = [q_line_dedup, q_decontaminate, q_quality_rules, q_token_counts, q_secret_scan, q_warc, q_near_dedup, q_binary_records, q_mixing, q_url_filter]


def queries() -> dict[str, Callable]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
