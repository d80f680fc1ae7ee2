"""Scan coverage: classified files, snapshots and coverage reports."""

from __future__ import annotations

from pyspark.sql import Window, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def classify(files: DataFrame) -> DataFrame:
    return files.select("snapshot_id", "repo_id", "file_path", X.path_skip_reason(F.col("file_path"), F.octet_length("content")).alias("skip_reason"), X.language_of(F.col("file_path")).alias("language"))


def snapshots(files: DataFrame) -> DataFrame:
    """Content-addressed records of the files that are loaded: everything but binary, vendored, oversized and bundled ones."""
    kept = files.where(F.coalesce(X.path_skip_reason(F.col("file_path"), F.octet_length("content")), F.lit("unsupported_language")) == "unsupported_language")
    digest = F.sha2(F.col("content"), 256)
    return kept.select("snapshot_id", "repo_id", "file_path", X.language_of(F.col("file_path")).alias("language"), F.octet_length("content").cast("long").alias("n_bytes"), digest.alias("sha256"), F.concat(F.lit("sha256:"), digest).alias("stored_at"))


def index_records(files: DataFrame) -> DataFrame:
    """Path records with a digest; unreadable content counts as unknown and empty."""
    return files.select("snapshot_id", "repo_id", "file_path", F.coalesce(F.sha1(F.col("content")), F.lit("unknown")).alias("sha1"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("n_bytes"))


def coverage(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per repository: files found, parsed, failed, skipped and discoverable, with the share covered.

    A file counts as parsed if any parse record of it has no error, as failed if all have some.
    Parse records are aggregated by file before the join.
    """
    by_file = parsed.groupBy("snapshot_id").agg(F.max((F.size(F.coalesce("errors", F.array())) == 0).cast("int")).alias("clean"))
    state = classify(files).join(by_file, "snapshot_id", "left")
    skipped = F.col("skip_reason").isNotNull()
    agg = state.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if(~skipped & (F.col("clean") == 1)).alias("parsed"),
        F.count_if(~skipped & (F.col("clean") == 0)).alias("failed"),
        F.count_if(skipped).alias("skipped"),
        F.count_if(~F.coalesce(F.col("skip_reason"), F.lit("")).isin("binary", "vendor_or_build_dir")).alias("discoverable"),
    )
    pct = F.when(F.col("discoverable") > 0, F.col("parsed") / F.col("discoverable") * 100.0).otherwise(F.lit(0.0))
    return agg.withColumn("coverage_pct", pct).withColumn("is_incomplete", F.col("coverage_pct") < 80)


def line_range(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines start..end of the files named by ranges(snapshot_id, start_line, end_line, ...)."""
    got = ranges.join(files.select("snapshot_id", X.lines_nl(F.col("content")).alias("lines")), "snapshot_id")
    n = F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1)
    return got.withColumn("cut", F.array_join(F.slice("lines", F.greatest(F.col("start_line"), F.lit(1)), n), "\n")).drop("lines")


def coverage_reports(files: DataFrame, parsed: DataFrame, errors: int = 20) -> DataFrame:
    """Coverage of each repository as a report: counts, skipped files by reason, languages, a message below 80 %, and the first parse errors in order of paths."""
    counts = coverage(files, parsed)
    kinds = classify(files)

    def listed(column: str) -> DataFrame:
        one = kinds.where(F.col(column).isNotNull()).groupBy("repo_id", column).agg(F.count(F.lit(1)).alias("n"))
        return one.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", column, F.col("n").cast("string")))), ",").alias(column))

    failed = parsed.where(F.size("errors") > 0).select("repo_id", "file_path", "snapshot_id", F.col("errors")[0].alias("error")).distinct()
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("file_path", "snapshot_id", "error"))
    first = failed.withColumn("place", place).where(F.col("place") <= errors).groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(": ", "file_path", "error").alias("said")))), lambda x: x["said"]), "\n").alias("parse_errors"))
    out = counts.join(listed("skip_reason"), "repo_id", "left").join(listed("language"), "repo_id", "left").join(first, "repo_id", "left")
    message = F.when(F.col("is_incomplete"), F.concat(F.lit("Only "), F.round("coverage_pct", 1).cast("string"), F.lit("% of codebase scanned (minimum 80% recommended)")))
    return out.select("repo_id", "discovered", "parsed", "failed", message.alias("message"), F.coalesce("skip_reason", F.lit("")).alias("skipped"), F.coalesce("language", F.lit("")).alias("languages"), F.coalesce("parse_errors", F.lit("")).alias("parse_errors"))
