from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus
from .registry import query, quoted, table

VENDOR = " OR ".join(f"contains(lower(file_path), '/{d}/') OR starts_with(lower(file_path), '{d}/')" for d in X.SKIP_DIRS)
BUNDLE = " OR ".join(f"ends_with(regexp_extract(file_path, '[^/]*$'), '{s}')" for s in X.BUNDLES)
EXT = "lower(regexp_extract(regexp_extract(file_path, '[^/]*$'), '^.+(\\.[^.]*)$', 1))"
REASON = f"""CASE WHEN octet_length(encode(content)) > 1048576 THEN 'too_large' WHEN {EXT} IN ({quoted(X.BINARY)}) THEN 'binary'
  WHEN {BUNDLE} THEN 'minified_or_bundle' WHEN {VENDOR} THEN 'vendor_or_build_dir'
  WHEN {EXT} NOT IN ({quoted([*X.PARSEABLE, *X.CONFIG])}) THEN 'unsupported_language' END"""
LANGUAGE = f"CASE {EXT} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.PARSEABLE.items()) + " END"


@query("pf1_classify_files", f"SELECT snapshot_id, repo_id, file_path, {REASON} AS skip_reason, {LANGUAGE} AS language FROM source_files")
def classify(spark, d):
    return corpus.classify(table(spark, d, "source_files"))


@query("sc3_file_snapshots", f"""
SELECT snapshot_id, repo_id, file_path, {LANGUAGE} AS language, octet_length(encode(content))::BIGINT AS n_bytes, sha256(content) AS sha256, 'sha256:' || sha256(content) AS stored_at
FROM source_files WHERE coalesce({REASON}, 'unsupported_language') = 'unsupported_language'""")
def snapshots(spark, d):
    return corpus.snapshots(table(spark, d, "source_files"))


@query("sc4_index_records", "SELECT snapshot_id, repo_id, file_path, coalesce(sha1(content), 'unknown') AS sha1, coalesce(octet_length(encode(content)), 0)::BIGINT AS n_bytes FROM source_files")
def index_records(spark, d):
    return corpus.index_records(table(spark, d, "source_files"))


@query("ag11_coverage", f"""
WITH p AS (SELECT snapshot_id, max(CASE WHEN coalesce(len(errors), 0) = 0 THEN 1 ELSE 0 END) AS clean FROM parse_results GROUP BY 1),
s AS (SELECT f.repo_id, {REASON} AS r, p.clean FROM source_files f LEFT JOIN p USING (snapshot_id)),
a AS (SELECT repo_id, count(*) AS discovered, count(*) FILTER (r IS NULL AND clean = 1) AS parsed, count(*) FILTER (r IS NULL AND clean = 0) AS failed,
  count(*) FILTER (r IS NOT NULL) AS skipped, count(*) FILTER (coalesce(r, '') NOT IN ('binary', 'vendor_or_build_dir')) AS discoverable FROM s GROUP BY 1)
SELECT *, CASE WHEN discoverable > 0 THEN parsed::DOUBLE / discoverable * 100.0::DOUBLE ELSE 0.0::DOUBLE END AS coverage_pct,
  (CASE WHEN discoverable > 0 THEN parsed::DOUBLE / discoverable * 100.0::DOUBLE ELSE 0.0::DOUBLE END) < 80 AS is_incomplete FROM a""")
def coverage(spark, d):
    return corpus.coverage(table(spark, d, "source_files"), table(spark, d, "parse_results"))


@query("ag12_skipped_reasons", f"""
WITH c AS (SELECT repo_id, {REASON} AS skip_reason FROM source_files)
SELECT repo_id, skip_reason, count(*) AS files, (sum(count(*)) OVER (PARTITION BY repo_id))::BIGINT AS skipped_total FROM c WHERE skip_reason IS NOT NULL GROUP BY 1, 2""")
def skipped_reasons(spark, d):
    from pyspark.sql import Window

    got = corpus.classify(table(spark, d, "source_files")).where("skip_reason IS NOT NULL").groupBy("repo_id", "skip_reason").agg(F.count(F.lit(1)).alias("files"))
    return got.withColumn("skipped_total", F.sum("files").over(Window.partitionBy("repo_id")))


@query("ag20_languages", f"""
SELECT repo_id, {LANGUAGE} AS language, count(DISTINCT file_path) AS files FROM source_files WHERE {LANGUAGE} IS NOT NULL GROUP BY 1, 2""")
def languages(spark, d):
    return corpus.classify(table(spark, d, "source_files")).where("language IS NOT NULL").groupBy("repo_id", "language").agg(F.countDistinct("file_path").alias("files"))


@query("sc6_line_ranges", """
WITH r AS (SELECT source_row_id, s.snapshot_id, s.start_line, s.end_line, string_split(f.content, chr(10)) AS lines FROM retrieved_sources s JOIN source_files f USING (snapshot_id))
SELECT source_row_id, snapshot_id, start_line, end_line, array_to_string(lines[greatest(start_line, 1) : greatest(start_line, 1) + greatest(0, end_line - start_line + 1) - 1], chr(10)) AS cut FROM r
WHERE start_line IS NOT NULL AND end_line IS NOT NULL""")
def line_ranges(spark, d):
    ranges = table(spark, d, "retrieved_sources").where("start_line IS NOT NULL AND end_line IS NOT NULL").select("source_row_id", "snapshot_id", "start_line", "end_line")
    return corpus.line_range(table(spark, d, "source_files"), ranges).select("source_row_id", "snapshot_id", "start_line", "end_line", "cut")


@query("sc5_tree_listing", f"""
WITH c AS (SELECT DISTINCT repo_id, file_path FROM source_files WHERE {EXT} IN ({quoted(X.LISTED)}) OR regexp_extract(file_path, '[^/]*$') IN ({quoted(X.ALWAYS)})),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_path) AS place FROM c)
SELECT repo_id, file_path, place::INTEGER AS place FROM r WHERE place <= 100""")
def tree_listing(spark, d):
    """The first hundred files of each repository that are worth a look, by extension or name, in path order: the cap is the feature."""
    from pyspark.sql import Window

    c = table(spark, d, "source_files").where(X.suffix(F.col("file_path")).isin(*X.LISTED) | X.basename(F.col("file_path")).isin(*X.ALWAYS)).select("repo_id", "file_path").distinct()
    return c.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy("file_path"))).where("place <= 100")


@query("sc8_repository_sizes", """
SELECT repo_id, count(*) AS files, sum(octet_length(encode(content)))::BIGINT AS n_bytes, max(created_at) AS newest FROM source_files GROUP BY 1""")
def sizes(spark, d):
    return table(spark, d, "source_files").groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("content")).alias("n_bytes"), F.max("created_at").alias("newest"))


@query("so6_latest_snapshot", """
SELECT repo_id, file_path, content_hash, snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY ingested_at DESC, snapshot_id DESC) AS rn FROM source_files) WHERE rn = 1""")
def latest(spark, d):
    """One row per path: the last one loaded, ties by id."""
    f = table(spark, d, "source_files")
    best = f.groupBy("repo_id", "file_path").agg(F.max_by(F.struct("snapshot_id", "content_hash"), F.struct("ingested_at", "snapshot_id")).alias("x"))
    return best.select("repo_id", "file_path", "x.content_hash", "x.snapshot_id")
