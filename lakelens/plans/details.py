"""Reports in full, evidence with what stands around it, and functions of paths, names and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus
from .answers import CHECKED, checked
from .corpus import LANGUAGE, REASON
from .registry import query, table
from .rules import REDACT


@query("ag11_reports", f"""
WITH p AS (SELECT snapshot_id, max(CASE WHEN coalesce(len(errors), 0) = 0 THEN 1 ELSE 0 END) AS clean FROM parse_results GROUP BY 1),
s AS (SELECT f.repo_id, {REASON} AS r, {LANGUAGE} AS l, p.clean FROM source_files f LEFT JOIN p USING (snapshot_id)),
a AS (SELECT repo_id, count(*) AS discovered, count(*) FILTER (r IS NULL AND clean = 1) AS parsed, count(*) FILTER (r IS NULL AND clean = 0) AS failed, count(*) FILTER (coalesce(r, '') NOT IN ('binary', 'vendor_or_build_dir')) AS discoverable FROM s GROUP BY 1),
b AS (SELECT *, CASE WHEN discoverable > 0 THEN parsed::DOUBLE / discoverable * 100.0::DOUBLE ELSE 0.0::DOUBLE END AS pct FROM a),
k AS (SELECT repo_id, string_agg(r || '=' || n, ',' ORDER BY r || '=' || n) AS skipped FROM (SELECT repo_id, r, count(*) AS n FROM s WHERE r IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT repo_id, string_agg(l || '=' || n, ',' ORDER BY l || '=' || n) AS languages FROM (SELECT repo_id, l, count(*) AS n FROM s WHERE l IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT repo_id, string_agg(said, chr(10) ORDER BY place) AS parse_errors FROM (SELECT repo_id, concat_ws(': ', file_path, error) AS said, row_number() OVER (PARTITION BY repo_id ORDER BY file_path, snapshot_id, error) AS place FROM (SELECT DISTINCT repo_id, file_path, snapshot_id, errors[1] AS error FROM parse_results WHERE len(errors) > 0)) WHERE place <= 20 GROUP BY 1)
SELECT b.repo_id, discovered, parsed, failed, CASE WHEN pct < 80 THEN 'Only ' || round(pct, 1)::VARCHAR || '% of codebase scanned (minimum 80% recommended)' END AS message, coalesce(skipped, '') AS skipped, coalesce(languages, '') AS languages, coalesce(parse_errors, '') AS parse_errors
FROM b LEFT JOIN k USING (repo_id) LEFT JOIN g USING (repo_id) LEFT JOIN e USING (repo_id)""")
def reports(spark, d):
    return corpus.coverage_reports(table(spark, d, "source_files"), table(spark, d, "parse_results"))


@query("ag19_evidence_metrics", f"""
WITH {CHECKED}, t AS (SELECT qa_id, count(*) AS quotes, count(*) FILTER (verdict = 'verified') AS verified FROM c GROUP BY 1), s1 AS (SELECT DISTINCT qa_id, source_index, file_path, score FROM c WHERE verdict <> 'unknown_source'),
m AS (SELECT qa_id, count(*) AS cited, count(DISTINCT file_path) AS files, round(avg(score), 6) AS avg_score, round(max(score), 6) AS max_score, round(min(score), 6) AS min_score, coalesce(bool_or(contains(lower(file_path), 'controller') OR contains(lower(file_path), 'route')), false) AS has_entrypoints FROM s1 GROUP BY 1)
SELECT m.*, quotes, verified, round(verified::DOUBLE / quotes, 2) AS verification_rate FROM m JOIN t USING (qa_id)""")
def metrics(spark, d):
    """Evidence of each answer: cited sources and files, their scores, and how many quotes hold."""
    c = checked(spark, d)
    t = c.groupBy("qa_id").agg(F.count(F.lit(1)).alias("quotes"), F.count_if(F.col("verdict") == "verified").alias("verified"))
    low = F.lower("file_path")
    score = lambda f: F.round(f("score"), 6)
    m = c.where("verdict <> 'unknown_source'").select("qa_id", "source_index", "file_path", "score").distinct().groupBy("qa_id").agg(
        F.count(F.lit(1)).alias("cited"), F.countDistinct("file_path").alias("files"), score(F.avg).alias("avg_score"), score(F.max).alias("max_score"), score(F.min).alias("min_score"), F.coalesce(F.bool_or(low.contains("controller") | low.contains("route")), F.lit(False)).alias("has_entrypoints")
    )
    return m.join(t, "qa_id").select("*", F.round(F.col("verified") / F.col("quotes"), 2).alias("verification_rate"))


@query("w7_context_lines", f"""
WITH m AS (SELECT DISTINCT match_id, snapshot_id, greatest(start_line - 1, 0) AS a, end_line AS e FROM finding_matches WHERE start_line IS NOT NULL AND end_line IS NOT NULL),
f AS (SELECT m.match_id, a, string_split(s.content, chr(10)) AS ls, e FROM m JOIN source_files s USING (snapshot_id)), g AS (SELECT *, least(len(ls), greatest(e, 0)) AS b FROM f),
c AS (SELECT match_id, CASE WHEN greatest(a - 2, 0) < a THEN array_to_string(ls[greatest(a - 2, 0) + 1 : a], chr(10)) END AS x, CASE WHEN b < least(len(ls), b + 2) THEN array_to_string(ls[b + 1 : b + 2], chr(10)) END AS y FROM g)
SELECT match_id, {REDACT.replace("(t,", "(x,")} AS context_before, {REDACT.replace("(t,", "(y,")} AS context_after FROM c""")
def context_lines(spark, d):
    """Up to two lines before and behind each finding, redacted; null where there are none."""
    m = table(spark, d, "finding_matches").where("start_line IS NOT NULL AND end_line IS NOT NULL").select("match_id", "snapshot_id", F.greatest(F.col("start_line") - 1, F.lit(0)).alias("a"), F.col("end_line").alias("e")).distinct()
    f = m.join(table(spark, d, "source_files").select("snapshot_id", X.lines_nl(F.col("content")).alias("ls")), "snapshot_id").withColumn("b", F.least(F.size("ls"), F.greatest(F.col("e"), F.lit(0))))
    low = F.greatest(F.col("a") - 2, F.lit(0))
    before = F.when(low < F.col("a"), F.array_join(F.slice("ls", low + 1, F.col("a") - low), "\n"))
    after = F.when(F.col("b") < F.size("ls"), F.array_join(F.slice("ls", F.col("b") + 1, F.lit(2)), "\n"))
    return f.select("match_id", X.redact_tokens(before).alias("context_before"), X.redact_tokens(after).alias("context_after"))


@query("f8_paths", """
WITH u AS (SELECT DISTINCT file_path AS p FROM source_files)
SELECT p, regexp_replace(p, '/[^/]*$', '') || '/lib/' || regexp_extract(p, '[^/]*$') AS normal, 'root/' || p AS joined, len(string_split(p, '/'))::INTEGER AS parts FROM u WHERE contains(p, '/') UNION ALL SELECT p, 'lib/' || p, 'root/' || p, 1 FROM u WHERE NOT contains(p, '/')""")
def paths(spark, d):
    """Paths put together from parts and detours, and made normal again."""
    p = F.col("file_path")
    up = F.concat(X.dirname(p), F.lit("/./x//../lib/"), X.basename(p))
    u = table(spark, d, "source_files").select("file_path").distinct()
    return u.select(p.alias("p"), X.normpath(F.when(p.contains("/"), up).otherwise(F.concat(F.lit("x/../lib/"), p))).alias("normal"), X.join_path(F.lit("root/"), p).alias("joined"), F.size(F.split(p, "/")).alias("parts"))


@query("f15_digests", "SELECT snapshot_id, substring(md5(content), 1, 12) AS short_md5, ('0x' || substring(sha1(content), 1, 12))::BIGINT AS number FROM source_files WHERE content IS NOT NULL")
def digests(spark, d):
    """Short digests, and the first twelve digits of one as a number."""
    f = table(spark, d, "source_files").where("content IS NOT NULL")
    return f.select("snapshot_id", F.left(F.md5("content"), F.lit(12)).alias("short_md5"), F.conv(F.left(F.sha1("content"), F.lit(12)), 16, 10).cast("long").alias("number"))


@query("f1_cases", "SELECT symbol_type, visibility, upper(left(coalesce(symbol_type, ''), 1)) || lower(substring(coalesce(symbol_type, ''), 2)) AS title, count(*) AS symbols, count(*) FILTER (regexp_matches(symbol_name, '[A-Z]') AND symbol_name = upper(symbol_name)) AS in_capitals FROM symbols GROUP BY 1, 2, 3")
def cases(spark, d):
    s = table(spark, d, "symbols")
    return s.groupBy("symbol_type", "visibility", F.initcap(F.coalesce("symbol_type", F.lit(""))).alias("title")).agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.coalesce(X.is_upper(F.col("symbol_name")), F.lit(False))).alias("in_capitals"))


@query("f18_addresses", """
WITH a AS (SELECT repo_id, owner_name, repo_name, unnest(['https://example.com/' || full_name || '.git', 'https://example.com/' || full_name || '/tree/main', 'git@example.com:' || full_name || '.git', 'file:' || repo_name]) AS url FROM repositories)
SELECT repo_id, url, CASE WHEN starts_with(url, 'file:') THEN NULL ELSE owner_name END AS owner, CASE WHEN starts_with(url, 'file:') THEN NULL ELSE repo_name END AS name FROM a""")
def addresses(spark, d):
    """Owner and name read back from addresses in several forms."""
    full = F.col("full_name")
    urls = F.array(F.concat(F.lit("https://example.com/"), full, F.lit(".git")), F.concat(F.lit("https://example.com/"), full, F.lit("/tree/main")), F.concat(F.lit("git@example.com:"), full, F.lit(".git")), F.concat(F.lit("file:"), "repo_name"))
    a = table(spark, d, "repositories").select("repo_id", F.explode(urls).alias("url"))
    return a.select("repo_id", "url", X.owner_and_name(F.col("url")).alias("x")).select("repo_id", "url", "x.owner", "x.name")


@query("ag2_money", "SELECT coalesce(event_type, 'total') AS event_type, round(sum(coalesce(value, 0)) / 100, 6) AS cents, round(sum(coalesce(value, 0)) / 10000, 6) AS dollars FROM events GROUP BY ROLLUP (event_type)")
def money(spark, d):
    """Sums in cents and dollars, by kind and in all."""
    total = F.sum(F.coalesce("value", F.lit(0.0)))
    return table(spark, d, "events").rollup("event_type").agg(F.round(total / 100, 6).alias("cents"), F.round(total / 10000, 6).alias("dollars")).withColumn("event_type", F.coalesce("event_type", F.lit("total")))
