"""Columns of the engine's inputs and the value domains that rows are checked against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILES = "snapshot_id long, scan_run_id string, repo_id string, file_path string, file_language string, content string, size_bytes int, content_hash string, created_at timestamp_ntz, ingested_at timestamp_ntz"
SYMBOLS = "symbol_id long, snapshot_id long, repo_id string, file_path string, symbol_name string, symbol_type string, qualified_name string, line_start int, line_end int, signature string, docstring string, body string, parent string, children array<string>, visibility string, created_at timestamp_ntz"
MATCHES = "match_id long, scan_run_id string, repo_id string, snapshot_id long, rule_id string, category string, title string, severity string, confidence string, file_path string, start_line int, end_line int, snippet string, evidence struct<code_snippet: string, rule_name: string, rule_trigger_reason: string, pattern_matched: string, context_lines: string>, tags array<string>, symbol string, created_at timestamp_ntz"

# fixed values: allowed values of checked columns
DOMAINS = {
    "severity": ["critical", "high", "medium", "low", "info", "warning"],
    "confidence": ["high", "medium", "low", "unknown"],
    "category": ["security", "privacy", "performance", "reliability", "maintainability", "architecture"],
    "symbol_type": ["class", "function", "method"],
    "index_status": ["pending", "indexing", "ready", "failed"],
    "confidence_tier": ["high", "medium", "low", "none"],
}


def split_valid(df: DataFrame, domains: dict[str, list[str]] = DOMAINS) -> tuple[DataFrame, DataFrame]:
    """Rows whose checked columns are null or within their domain, and the rest with the failing columns named."""
    checks = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(v), F.lit(c)) for c, v in domains.items() if c in df.columns]
    if not checks:
        return df, df.where(F.lit(False)).withColumn("failed", F.array().cast("array<string>"))
    marked = df.withColumn("failed", F.array_compact(F.array(*checks)))
    return marked.where(F.size("failed") == 0).drop("failed"), marked.where(F.size("failed") > 0)


def any_of(conditions):
    return reduce(lambda a, b: a | b, conditions)
