"""Problem 2: source files that do not parse.

Every file with a known extension goes through a recursive-descent parser (statements by
descent, expressions by precedence climbing, panic-mode recovery after an error), so a file
yields all its errors and its first cause. For Python and JSON the language's own parser in
the runtime confirms a finding afterwards. The stage is one map over the files without a
shuffle; only the rates and the distinct keys of broken files are shuffled, pre-aggregated.

Defined cases: null content or path, other extensions and blank files are no defects; a null
language or repository is a group of its own in the rates; repeated input rows count as rows
in the rates and once in the keys; extra columns are ignored; an empty table gives no rows.
Text nested deeper than the parser follows is judged by its brackets alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grammar import PARSERS, blank, extension, parse
from .rows import map_rows

ERRORS = "snapshot_id long, repo_id string, file_path string, file_language string, first_line long, first_error string, n_errors int, errors array<string>"


def known_extension(path="file_path"):
    return F.lower(F.regexp_extract(F.col(path), r"\.([A-Za-z]+)$", 1)).isin(*PARSERS)


def _checker():
    def one(snapshot_id, repo_id, path, language, content):
        ext = extension(path)
        if blank(ext, content):
            return
        p = parse(ext, content)
        if p.errors:
            starts, breaks = p.positions()[0], [m.start() for m in re.finditer("\n", p.text)]
            lines = [(bisect_left(breaks, starts[at]) + 1, what) for at, what in p.errors]
            yield snapshot_id, repo_id, path, language, lines[0][0], lines[0][1], len(lines), [f"{n}: {what}" for n, what in lines]

    return one


def syntax_errors(files: DataFrame) -> DataFrame:
    """One row per broken file: its first cause and all errors with their lines."""
    src = files.where(known_extension() & F.col("content").isNotNull()).select("snapshot_id", "repo_id", "file_path", "file_language", "content")
    return map_rows(src, _checker, ERRORS)


def broken_files(files: DataFrame) -> DataFrame:
    """snapshot_id of each broken file, once."""
    return syntax_errors(files).select("snapshot_id").distinct()


def error_rates(files: DataFrame) -> DataFrame:
    """Files, broken files and their share per repository and recorded language (null is a group of its own)."""
    keys = ["repo_id", "file_language"]
    all_files = files.where(known_extension()).groupBy(*keys).agg(F.count(F.lit(1)).alias("files"))
    broken = syntax_errors(files).groupBy(*keys).agg(F.count(F.lit(1)).alias("broken"))
    a, b = all_files.alias("a"), broken.alias("b")
    on = F.col("a.repo_id").eqNullSafe(F.col("b.repo_id")) & F.col("a.file_language").eqNullSafe(F.col("b.file_language"))
    n = F.coalesce("b.broken", F.lit(0))
    return a.join(b, on, "left").select("a.repo_id", "a.file_language", "a.files", n.alias("broken"), (n / F.col("a.files")).alias("broken_rate"))
