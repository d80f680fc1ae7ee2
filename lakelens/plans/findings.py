from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import findings
from .registry import query, table

M = "(SELECT DISTINCT match_id, rule_id, category, title, severity, confidence, file_path, repo_id, snapshot_id, start_line, end_line, symbol, evidence, tags FROM finding_matches)"
RANK = "CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
SAFETY = "CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 12 WHEN 'medium' THEN 6 WHEN 'low' THEN 3 WHEN 'info' THEN 1 ELSE 0 END"


def unique(spark, d):
    """Repeated match rows are one match: one row per id."""
    return table(spark, d, "finding_matches").dropDuplicates(["match_id"])


@query("findings_by_severity", f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY rule_id, file_path, start_line // 10 ORDER BY {RANK} DESC, start_line DESC, match_id) AS rn FROM {M} WHERE start_line IS NOT NULL)
SELECT category, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS findings FROM k WHERE rn = 1 GROUP BY 1""")
def by_severity(spark, d):
    kept = findings.dedup_by_region(unique(spark, d).where("start_line IS NOT NULL"))
    return kept.groupBy("category").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")], F.count(F.lit(1)).alias("findings"))


@query("ag6_dedup_regions", f"""
SELECT match_id, rule_id, file_path, (start_line // 10) * 10 AS region, start_line FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, file_path, start_line // 10 ORDER BY {RANK} DESC, start_line DESC, match_id) AS rn FROM {M} WHERE start_line IS NOT NULL) WHERE rn = 1""")
def dedup_regions(spark, d):
    return findings.dedup_by_region(unique(spark, d).where("start_line IS NOT NULL")).select("match_id", "rule_id", "file_path", "region", "start_line")


@query("ag7_dedup_keys", f"""
WITH k AS (SELECT *, sha256(rule_id || '|||' || coalesce(symbol, '') || '|' || regexp_extract(file_path, '^(.*)/[^/]*$', 1)) AS dedupe_key FROM {M})
SELECT dedupe_key, min(match_id) AS first_match, arg_min(category, match_id) AS category, arg_min(title, match_id) AS title, count(*) AS instances FROM k GROUP BY 1""")
def dedup_keys(spark, d):
    return findings.dedup_by_key(unique(spark, d)).select("dedupe_key", "first_match", "category", "title", "instances")


@query("ag8_groups", f"""
WITH g AS (SELECT rule_id, category, count(*) AS findings, min(match_id) AS first_match FROM {M} GROUP BY 1, 2)
SELECT rule_id, category, findings, first_match, findings || ' ' || category || ' finding(s)' AS description FROM g""")
def groups(spark, d):
    g = unique(spark, d).groupBy("rule_id", "category").agg(F.count(F.lit(1)).alias("findings"), F.min("match_id").alias("first_match"))
    return g.withColumn("description", F.concat(F.col("findings").cast("string"), F.lit(" "), "category", F.lit(" finding(s)")))


@query("ag9_summary", f"""
WITH g AS (SELECT repo_id, category, count(*) AS n FROM {M} GROUP BY 1, 2)
SELECT repo_id, sum(n)::BIGINT || ' unique issue(s): ' || string_agg(category || ' (' || n || ')', ', ' ORDER BY n DESC, category) AS summary FROM g GROUP BY 1""")
def summary(spark, d):
    g = unique(spark, d).groupBy("repo_id", "category").agg(F.count(F.lit(1)).alias("n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "category", "n")))
    said = F.array_join(F.transform(parts, lambda x: F.concat(x["category"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ")
    return g.groupBy("repo_id").agg(F.sum("n").alias("total"), parts.alias("p"), said.alias("said")).select("repo_id", F.concat(F.col("total").cast("string"), F.lit(" unique issue(s): "), "said").alias("summary"))


@query("ag10_dedup_stats", f"""
WITH u AS (SELECT count(DISTINCT sha256(rule_id || '|||' || coalesce(symbol, '') || '|' || regexp_extract(file_path, '^(.*)/[^/]*$', 1))) AS kept FROM {M}), r AS (SELECT count(*) AS raw FROM finding_matches)
SELECT raw, kept, CASE WHEN raw = 0 THEN 0.0 ELSE round(kept::DOUBLE / raw, 6) END AS ratio FROM u, r""")
def stats(spark, d):
    from ..functions import text as X

    m = table(spark, d, "finding_matches")
    key = F.concat_ws("|", "rule_id", F.coalesce("symbol", F.lit("")), X.dirname(F.col("file_path")))
    return m.agg(F.count(F.lit(1)).alias("raw"), F.countDistinct(key).alias("kept")).withColumn("ratio", F.round(F.coalesce(F.try_divide("kept", "raw"), F.lit(0.0)), 6))


OK = "coalesce(length(file_path) > 0 AND length(evidence.rule_trigger_reason) > 0 AND start_line > 0 AND end_line > 0 AND length(trim(evidence.code_snippet)) > 0, false)"


@query("pf10_evidence_complete", f"SELECT {OK} AS is_complete, count(*) AS findings, count(*) FILTER (NOT {OK} AND severity <> 'info') AS downgraded FROM {M} GROUP BY 1")
def evidence_complete(spark, d):
    ok = findings.complete(F.col("file_path"), F.col("evidence.rule_trigger_reason"), F.col("start_line"), F.col("end_line"), F.col("evidence.code_snippet"))
    return unique(spark, d).withColumn("is_complete", ok).groupBy("is_complete").agg(F.count(F.lit(1)).alias("findings"), F.count_if(~F.col("is_complete") & (F.col("severity") != "info")).alias("downgraded"))


@query("s_scores", f"""
WITH b AS (SELECT match_id, rule_id, CASE WHEN {OK} THEN severity ELSE 'info' END AS severity, lower(file_path) AS p, lower(coalesce(evidence.code_snippet, '')) AS s, coalesce(evidence.code_snippet, '') AS raw, lower(coalesce(evidence.rule_name, '')) AS n, coalesce(tags, []) AS tags FROM {M}),
c AS (SELECT *, coalesce(list_max(list_transform(tags, lambda t: CASE lower(t) WHEN 'credentials' THEN 95 WHEN 'payment_data' THEN 90 WHEN 'health_data' THEN 95 WHEN 'student_data' THEN 85 WHEN 'logs' THEN 40 WHEN 'public_data' THEN 10 WHEN 'configuration' THEN 50 ELSE 50 END)), 0) AS most,
 CASE WHEN s LIKE '%console.log%' OR s LIKE '%print(%' OR s LIKE '%log(%' OR s LIKE '%logger.%' THEN 'logged' WHEN s LIKE '%http%' OR s LIKE '%api%' OR s LIKE '%fetch%' OR s LIKE '%axios%' OR s LIKE '%requests.%' THEN 'third_party' WHEN n LIKE '%secret%' OR n LIKE '%key%' THEN 'direct' ELSE 'internal' END AS flow,
 CASE WHEN p LIKE '%routes/%' OR p LIKE '%api/%' OR p LIKE '%controller%' THEN 'internet-facing' WHEN p LIKE '%internal%' OR p LIKE '%private%' OR p LIKE '%admin%' THEN 'internal' ELSE 'authenticated' END AS exposure,
 CASE WHEN s LIKE '%auth%' OR s LIKE '%login%' OR s LIKE '%session%' OR s LIKE '%token%' THEN 30 ELSE 90 END AS effort FROM b)
SELECT match_id, rule_id, severity, trunc(most * 0.6::DOUBLE + (CASE flow WHEN 'direct' THEN 90 WHEN 'logged' THEN 70 WHEN 'third_party' THEN 60 ELSE 30 END) * 0.4::DOUBLE)::INTEGER AS impact, flow,
 trunc((CASE exposure WHEN 'internet-facing' THEN 90 WHEN 'authenticated' THEN 60 ELSE 30 END) * 0.6::DOUBLE + effort * 0.4::DOUBLE)::INTEGER AS exploitability, exposure,
 CASE WHEN n LIKE '%secret%' OR n LIKE '%key%' THEN 95 WHEN n LIKE '%migration%' AND n LIKE '%drop%' THEN 90 WHEN n LIKE '%middleware%' THEN 85 WHEN length(raw) > 20 THEN 70 ELSE 50 END AS confidence_score FROM c""")
def scores(spark, d):
    return findings.scored(unique(spark, d))


@query("ag16_safety", f"""
SELECT repo_id, greatest(0, 100 - sum({SAFETY}))::BIGINT AS safety FROM {M} GROUP BY 1""")
def safety(spark, d):
    return unique(spark, d).groupBy("repo_id").agg(findings.safety_score(F.col("severity")).cast("long").alias("safety"))


@query("ag14_penalty_score", f"""
WITH c AS (SELECT repo_id, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m, count(*) FILTER (severity = 'low') AS l FROM {M} GROUP BY 1)
SELECT repo_id, greatest(0, 100 - 25 * c - 10 * h - 5 * m - 2 * l)::BIGINT AS score, CASE WHEN c > 0 THEN 'critical' WHEN h > 2 THEN 'high' WHEN h > 0 OR m > 3 THEN 'medium' ELSE 'low' END AS risk FROM c""")
def penalty(spark, d):
    n = {s: F.count_if(F.col("severity") == s) for s in ("critical", "high", "medium", "low")}
    g = unique(spark, d).groupBy("repo_id").agg(*[v.alias(k) for k, v in n.items()])
    score = F.greatest(F.lit(0), F.lit(100) - 25 * F.col("critical") - 10 * F.col("high") - 5 * F.col("medium") - 2 * F.col("low"))
    risk = F.when(F.col("critical") > 0, "critical").when(F.col("high") > 2, "high").when((F.col("high") > 0) | (F.col("medium") > 3), "medium").otherwise("low")
    return g.select("repo_id", score.cast("long").alias("score"), risk.alias("risk"))


@query("ag15_first_titles", f"""
SELECT repo_id, title, place::INTEGER AS place FROM (SELECT repo_id, title, row_number() OVER (PARTITION BY repo_id ORDER BY min(match_id), title) AS place FROM {M} WHERE title <> '' GROUP BY 1, 2) WHERE place <= 10""")
def first_titles(spark, d):
    """The ten titles seen first in each repository: a top list."""
    t = unique(spark, d).where("title <> ''").groupBy("repo_id", "title").agg(F.min("match_id").alias("first"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy("first", "title"))).where("place <= 10").select("repo_id", "title", "place")


@query("s5_adjusted_confidence", f"""
WITH p AS (SELECT repo_id, avg(CASE WHEN coalesce(len(errors), 0) = 0 THEN 100.0 ELSE 0.0 END) AS pct FROM parse_results GROUP BY 1),
j AS (SELECT m.match_id, m.confidence, (CASE WHEN coalesce(p.pct, 0) < 80 THEN 1 ELSE 0 END) + (CASE WHEN m.symbol IS NULL THEN 1 ELSE 0 END) AS steps FROM {M} m LEFT JOIN p USING (repo_id)),
o AS (SELECT *, CASE confidence WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' WHEN 'low' THEN 'unknown' ELSE confidence END AS once FROM j)
SELECT match_id, CASE steps WHEN 0 THEN confidence WHEN 1 THEN once ELSE CASE once WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' WHEN 'low' THEN 'unknown' ELSE once END END AS confidence FROM o""")
def adjusted(spark, d):
    p = table(spark, d, "parse_results").groupBy("repo_id").agg(F.avg(F.when(F.size(F.coalesce("errors", F.array())) == 0, 100.0).otherwise(0.0)).alias("pct"))
    j = unique(spark, d).join(p, "repo_id", "left")
    steps = (F.coalesce("pct", F.lit(0.0)) < 80).cast("int") + F.col("symbol").isNull().cast("int")
    return j.select("match_id", findings.stepped_confidence(F.col("confidence"), steps).alias("confidence"))


@query("j6_controls", f"""
WITH c(control_id) AS (VALUES ('security'), ('SEC-001'), ('privacy.consent'), ('reliability.timeouts'), ('performance')), h AS (SELECT DISTINCT rule_id AS k FROM {M} UNION SELECT DISTINCT category FROM {M})
SELECT control_id, CASE WHEN control_id IN (SELECT k FROM h WHERE k IS NOT NULL) THEN 'fail' ELSE 'unknown' END AS status FROM c""")
def controls(spark, d):
    """A control fails if a finding carries it as rule or category: the OR becomes one key column on each side."""
    m = table(spark, d, "finding_matches")
    keys = m.select(F.explode(F.array("rule_id", "category")).alias("control_id")).distinct().withColumn("hit", F.lit(True))
    c = spark.createDataFrame([(x,) for x in ("security", "SEC-001", "privacy.consent", "reliability.timeouts", "performance")], "control_id string")
    return c.join(keys, "control_id", "left").select("control_id", F.when(F.col("hit"), "fail").otherwise("unknown").alias("status"))


@query("j8_overlapping_tags", f"""
WITH t AS (SELECT match_id, unnest(tags) AS tag FROM {M}), w AS (SELECT DISTINCT tag FROM t WHERE match_id IN (SELECT match_id FROM {M} WHERE severity = 'critical'))
SELECT match_id, count(DISTINCT tag) AS shared FROM t WHERE tag IN (SELECT tag FROM w) GROUP BY 1""")
def overlapping(spark, d):
    """Findings sharing a tag with a critical one: set overlap as an equi-join on exploded members."""
    t = unique(spark, d).select("match_id", "severity", F.explode("tags").alias("tag"))
    w = t.where("severity = 'critical'").select("tag").distinct()
    return t.join(w, "tag", "left_semi").groupBy("match_id").agg(F.countDistinct("tag").alias("shared"))


@query("ag27_prompt_inputs", f"""
WITH f AS (SELECT repo_id, rule_id, file_path, count(*) AS n FROM {M} WHERE file_path IS NOT NULL GROUP BY 1, 2, 3), t AS (SELECT repo_id, rule_id, count(*) AS files, sum(n)::BIGINT AS findings FROM f GROUP BY 1, 2),
s AS (SELECT repo_id, count(*) AS repo_findings, count(*) FILTER (severity = 'critical') AS critical FROM {M} GROUP BY 1)
SELECT f.repo_id, f.rule_id, f.file_path, f.n, t.files, t.findings, s.repo_findings, s.critical FROM f JOIN t USING (repo_id, rule_id) JOIN s USING (repo_id)""")
def prompt_inputs(spark, d):
    """Files of each rule, one row each, with the totals of the rule and the summary of the repository."""
    m = unique(spark, d)
    f = m.where("file_path IS NOT NULL").groupBy("repo_id", "rule_id", "file_path").agg(F.count(F.lit(1)).alias("n"))
    t = f.groupBy("repo_id", "rule_id").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("findings"))
    s = m.groupBy("repo_id").agg(F.count(F.lit(1)).alias("repo_findings"), F.count_if(F.col("severity") == "critical").alias("critical"))
    return f.join(t, ["repo_id", "rule_id"]).join(s, "repo_id").select("repo_id", "rule_id", "file_path", "n", "files", "findings", "repo_findings", "critical")


@query("d9_review_body", f"""
WITH g AS (SELECT repo_id, severity, count(*) AS n FROM {M} WHERE severity IS NOT NULL GROUP BY 1, 2), b AS (SELECT repo_id, string_agg('- ' || severity || ': ' || n, chr(10) ORDER BY severity) AS body, max(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS c FROM g GROUP BY 1)
SELECT repo_id, body, CASE WHEN c = 1 THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS event FROM b""")
def review_body(spark, d):
    g = unique(spark, d).where("severity IS NOT NULL").groupBy("repo_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat(F.lit("- "), "severity", F.lit(": "), F.col("n").cast("string"))
    b = g.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"), F.max((F.col("severity") == "critical").cast("int")).alias("c"))
    return b.select("repo_id", "body", F.when(F.col("c") == 1, "REQUEST_CHANGES").otherwise("COMMENT").alias("event"))


@query("d9_inline_comments", f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_path, start_line, match_id) AS place FROM {M} WHERE severity = 'critical' AND file_path IS NOT NULL AND start_line IS NOT NULL)
SELECT repo_id, match_id, file_path AS path, start_line AS line, '**' || coalesce(title, rule_id) || '** (`' || rule_id || '`)' AS body, place::INTEGER AS place FROM t WHERE place <= 10""")
def inline_comments(spark, d):
    """The first ten critical findings of each repository as comments on their lines: the cap is the feature."""
    m = unique(spark, d).where("severity = 'critical' AND file_path IS NOT NULL AND start_line IS NOT NULL")
    body = F.concat(F.lit("**"), F.coalesce("title", "rule_id"), F.lit("** (`"), "rule_id", F.lit("`)"))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("file_path", "start_line", "match_id"))
    return m.withColumn("place", place).where("place <= 10").select("repo_id", "match_id", F.col("file_path").alias("path"), F.col("start_line").alias("line"), body.alias("body"), "place")
