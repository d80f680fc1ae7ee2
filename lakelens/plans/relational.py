from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, table


def live(spark, d):
    """Repositories that are not deleted: a table of fixed size."""
    return table(spark, d, "repositories").where("deleted_at IS NULL")


@query("pf6_live_repositories", "SELECT repo_id, full_name, index_status, created_at FROM repositories WHERE deleted_at IS NULL ORDER BY created_at DESC, repo_id")
def live_repositories(spark, d):
    return live(spark, d).select("repo_id", "full_name", "index_status", "created_at").orderBy(F.desc("created_at"), "repo_id")


@query("j1_findings_listing", """
WITH m AS (SELECT DISTINCT match_id, scan_run_id, repo_id, rule_id, category, severity, snapshot_id FROM finding_matches)
SELECT m.repo_id, r.full_name, m.rule_id, m.category, count(f.snapshot_id) AS instances FROM m JOIN repositories r ON r.repo_id = m.repo_id AND r.deleted_at IS NULL
LEFT JOIN source_files f ON f.snapshot_id = m.snapshot_id AND f.scan_run_id = m.scan_run_id GROUP BY ALL""")
def findings_listing(spark, d):
    """Findings of live repositories with the number of instances that lie in a loaded file (zero if none)."""
    m = table(spark, d, "finding_matches").select("match_id", "scan_run_id", "repo_id", "rule_id", "category", "severity", "snapshot_id").distinct()
    f = table(spark, d, "source_files").select("snapshot_id", "scan_run_id", F.lit(1).alias("here"))
    own = m.join(live(spark, d).select("repo_id", "full_name"), "repo_id")
    return own.join(f, ["snapshot_id", "scan_run_id"], "left").groupBy("repo_id", "full_name", "rule_id", "category").agg(F.count("here").alias("instances"))


@query("j2_owned_parse_results", """
SELECT r.owner_name, count(*) AS records, sum(p.symbol_count)::BIGINT AS symbol_count, count(*) FILTER (len(p.errors) > 0) AS with_errors FROM parse_results p JOIN repositories r USING (repo_id) WHERE r.deleted_at IS NULL GROUP BY 1""")
def owned(spark, d):
    p = table(spark, d, "parse_results").join(live(spark, d).select("repo_id", "owner_name"), "repo_id")
    return p.groupBy("owner_name").agg(F.count(F.lit(1)).alias("records"), F.sum("symbol_count").alias("symbol_count"), F.count_if(F.size("errors") > 0).alias("with_errors"))


@query("j3_finding_details", """
WITH p AS (SELECT DISTINCT repo_id, rule_id, file_path, start_line FROM finding_matches WHERE start_line IS NOT NULL AND file_path IS NOT NULL), n AS (SELECT repo_id, rule_id, count(*) AS places FROM p GROUP BY 1, 2)
SELECT p.repo_id, p.rule_id, n.places, p.file_path, p.start_line FROM p JOIN n ON n.repo_id IS NOT DISTINCT FROM p.repo_id AND n.rule_id IS NOT DISTINCT FROM p.rule_id""")
def details(spark, d):
    """Places of each rule in a repository, one row each beside their number, so no rule gathers all of its places in one row."""
    p = table(spark, d, "finding_matches").where("start_line IS NOT NULL AND file_path IS NOT NULL").select("repo_id", "rule_id", "file_path", "start_line").distinct()
    n = p.groupBy(F.col("repo_id").alias("r"), F.col("rule_id").alias("k")).agg(F.count(F.lit(1)).alias("places"))
    return p.join(n, F.col("repo_id").eqNullSafe(F.col("r")) & F.col("rule_id").eqNullSafe(F.col("k"))).select("repo_id", "rule_id", "places", "file_path", "start_line")


@query("j4_findings_in_failed_files", """
SELECT DISTINCT match_id, rule_id, file_path FROM finding_matches WHERE snapshot_id IN (SELECT snapshot_id FROM parse_results WHERE len(errors) > 0)""")
def in_failed(spark, d):
    failed = table(spark, d, "parse_results").where(F.size("errors") > 0).select("snapshot_id")
    return table(spark, d, "finding_matches").join(failed, "snapshot_id", "left_semi").select("match_id", "rule_id", "file_path").distinct()


@query("j22_files_without_findings", """
SELECT f.repo_id, count(*) AS files FROM source_files f WHERE NOT EXISTS (SELECT 1 FROM finding_matches m WHERE m.snapshot_id = f.snapshot_id) GROUP BY 1""")
def without_findings(spark, d):
    return table(spark, d, "source_files").join(table(spark, d, "finding_matches").select("snapshot_id"), "snapshot_id", "left_anti").groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"))


@query("ag4_facets", """
WITH m AS (SELECT DISTINCT match_id, category, severity, confidence FROM finding_matches)
SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(severity) = 0 THEN 'severity' ELSE 'confidence' END AS facet, coalesce(category, severity, confidence) AS value, count(*) AS findings
FROM m GROUP BY GROUPING SETS ((category), (severity), (confidence)) HAVING coalesce(category, severity, confidence) <> ''""")
def facets(spark, d):
    """Three counts in one pass; empty and null values are dropped."""
    m = table(spark, d, "finding_matches").select("match_id", "category", "severity", "confidence").distinct()
    cols = [F.col(c) for c in ("category", "severity", "confidence")]
    got = m.groupingSets([[cols[0]], [cols[1]], [cols[2]]], *cols).agg(F.count(F.lit(1)).alias("findings"), F.grouping("category").alias("a"), F.grouping("severity").alias("b"))
    value = F.coalesce("category", "severity", "confidence")
    return got.where(value != "").select(F.when(F.col("a") == 0, "category").when(F.col("b") == 0, "severity").otherwise("confidence").alias("facet"), value.alias("value"), "findings")


@query("pf9_valid_answers", """
SELECT qa_id, repo_id FROM qa_results WHERE created_at + INTERVAL 1 HOUR > (SELECT max(created_at) - INTERVAL 30 DAY FROM qa_results) AND confidence_tier IS NOT NULL""")
def valid_answers(spark, d):
    """Cached answers still valid at a given time; the time is a parameter, here thirty days before the newest row."""
    q = table(spark, d, "qa_results")
    as_of = q.agg((F.max("created_at") - F.expr("INTERVAL 30 DAYS")).alias("as_of"))
    return q.join(F.broadcast(as_of), F.expr("created_at + INTERVAL 1 HOUR") > F.col("as_of")).where("confidence_tier IS NOT NULL").select("qa_id", "repo_id")


@query("st10_last_status", """
SELECT repo_id, arg_max(index_status, created_at) AS index_status FROM repositories GROUP BY 1""")
def last_status(spark, d):
    return table(spark, d, "repositories").groupBy("repo_id").agg(F.max_by("index_status", "created_at").alias("index_status"))


@query("pf8_orders_in_range", """
SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31' GROUP BY 1""")
def in_range(spark, d):
    o = table(spark, d, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00' AND o_orderdate <= TIMESTAMP_NTZ '1996-12-31 00:00:00'")
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
