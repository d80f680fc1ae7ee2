from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers, rules
from ..streaming import windows
from .answers import CHECKED
from .parsing import DECLARED, routes
from .registry import query, table


@query("ag18_routes_by_controller", f"""
SELECT controller, count(*) AS routes, count(DISTINCT snapshot_id) AS files, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM source_files JOIN (VALUES {DECLARED}) v(shape, method, uri, controller, action, middleware) ON snapshot_id % 3 = shape WHERE ends_with(file_path, '.php') GROUP BY 1""")
def routes_by_controller(spark, d):
    return routes(spark, d).groupBy("controller").agg(F.count(F.lit(1)).alias("routes"), F.countDistinct("snapshot_id").alias("files"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"))


@query("ag28_citation_counts", """
WITH e AS (SELECT repo_id, qa_id, unnest(quoted_spans) AS s FROM qa_results) SELECT repo_id, count(*) AS citations, count(DISTINCT qa_id || ':' || s.source_id) AS distinct_citations FROM e WHERE s.source_id IS NOT NULL GROUP BY 1""")
def citation_counts(spark, d):
    e = table(spark, d, "qa_results").select("repo_id", "qa_id", F.explode("quoted_spans").alias("s")).where("s.source_id IS NOT NULL")
    return e.groupBy("repo_id").agg(F.count(F.lit(1)).alias("citations"), F.countDistinct(F.concat_ws(":", F.col("qa_id").cast("string"), F.col("s.source_id").cast("string"))).alias("distinct_citations"))


@query("a2_short_quotes", f"""
WITH {CHECKED}, w AS (SELECT qa_id, span_no, verdict, string_split(trim(regexp_replace(quote, '\\s+', ' ', 'g')), ' ') AS qw, string_split(trim(regexp_replace(content, '\\s+', ' ', 'g')), ' ') AS sw FROM c)
SELECT qa_id, span_no, verdict = 'verified' OR coalesce(len(qw) <= 3 AND len(list_filter(qw, lambda x: NOT list_contains(sw, x))) = 0, false) AS is_supported FROM w""")
def short_quotes(spark, d):
    """Quotes of up to three words also count if each word is one of the source."""
    q = table(spark, d, "qa_results").select("qa_id", F.posexplode("quoted_spans").alias("span_no", "span"))
    s = table(spark, d, "retrieved_sources").groupBy("qa_id", "source_index").agg(F.min_by("content", "source_row_id").alias("content"))
    j = q.select("qa_id", "span_no", F.col("span.source_id").alias("source_index"), F.col("span.quoted_text").alias("quote")).join(s, ["qa_id", "source_index"], "left")
    return j.select("qa_id", "span_no", F.coalesce(answers.short_quote_found(F.col("quote"), F.col("content")), F.lit(False)).alias("is_supported"))


@query("a3_claims", """
WITH p AS (SELECT qa_id, from_json(answer_text, '{"sections":[{"text":"VARCHAR","source_ids":["INTEGER"]}]}') AS a FROM qa_results WHERE json_valid(answer_text) AND starts_with(trim(answer_text), '{') AND json_type(answer_text, '$.sections') = 'ARRAY'),
s AS (SELECT qa_id, unnest(a.sections) AS section, generate_subscripts(a.sections, 1) - 1 AS section_no FROM p)
SELECT qa_id, section_no::INTEGER AS section_no, unnest(section.source_ids) AS source_id, length(section.text)::INTEGER AS n_chars FROM s""")
def claims(spark, d):
    a = table(spark, d, "qa_results").select("qa_id", answers.repaired(F.col("answer_text")).alias("a")).where("a IS NOT NULL")
    s = a.select("qa_id", F.posexplode("a.sections").alias("section_no", "section"))
    return s.select("qa_id", "section_no", F.explode("section.source_ids").alias("source_id"), F.length("section.text").alias("n_chars"))


@query("j16_claimed_against_checked", f"""
WITH {CHECKED}, k AS (SELECT qa_id, unnest(quoted_spans) AS span, generate_subscripts(quoted_spans, 1) - 1 AS span_no FROM qa_results)
SELECT coalesce(k.span.verified::VARCHAR, 'null') AS claimed, c.verdict, count(*) AS spans FROM c JOIN k ON k.qa_id = c.qa_id AND k.span_no = c.span_no GROUP BY 1, 2""")
def claimed_against_checked(spark, d):
    c = answers.checked_quotes(table(spark, d, "qa_results"), table(spark, d, "retrieved_sources"))
    return c.groupBy(F.coalesce(F.col("claimed").cast("string"), F.lit("null")).alias("claimed"), "verdict").agg(F.count(F.lit(1)).alias("spans"))


@query("j18_symbol_files", """
WITH f AS (SELECT repo_id, file_path, max(snapshot_id) AS file_id FROM source_files GROUP BY 1, 2)
SELECT s.symbol_id, f.file_id FROM symbols s JOIN f ON f.repo_id = s.repo_id AND f.file_path = s.file_path""")
def symbol_files(spark, d):
    f = table(spark, d, "source_files").groupBy("repo_id", "file_path").agg(F.max("snapshot_id").alias("file_id"))
    return table(spark, d, "symbols").join(f, ["repo_id", "file_path"]).select("symbol_id", "file_id")


@query("f16_canonical_hash", """
SELECT repo_id, sha256('{"branch":"' || default_branch || '","name":"' || full_name || '","private":' || is_private || '}') AS config_hash FROM repositories""")
def canonical_hash(spark, d):
    """Keys in alphabetical order, no blanks: the same settings give the same digest."""
    j = F.to_json(F.struct(F.col("default_branch").alias("branch"), F.col("full_name").alias("name"), F.col("is_private").alias("private")))
    return table(spark, d, "repositories").select("repo_id", F.sha2(j, 256).alias("config_hash"))


@query("pf16_gated_events", """
SELECT user_id, count(*) AS queued FROM events e WHERE event_type IN ('purchase', 'view', 'click') AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1""")
def gated(spark, d):
    """Events of known accounts that would queue work; the accounts are a semi-join, not a broadcast."""
    known = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    e = table(spark, d, "events").where(windows.route(F.col("event_type")).isin("push", "pull_request"))
    return e.join(known, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("queued"))


@query("st2_deleted_with_parent", """
SELECT r.repo_id, count(f.snapshot_id) AS orphaned FROM repositories r LEFT JOIN source_files f USING (repo_id) WHERE r.deleted_at IS NOT NULL GROUP BY 1""")
def deleted(spark, d):
    r = table(spark, d, "repositories").where("deleted_at IS NOT NULL").select("repo_id")
    n = table(spark, d, "source_files").join(r, "repo_id", "left_semi").groupBy("repo_id").agg(F.count(F.lit(1)).alias("orphaned"))
    return table(spark, d, "repositories").where("deleted_at IS NOT NULL").select("repo_id").join(n, "repo_id", "left").select("repo_id", F.coalesce("orphaned", F.lit(0)).alias("orphaned"))


@query("tk7_newest_findings", """
SELECT repo_id, match_id, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, match_id) AS place FROM (SELECT DISTINCT repo_id, match_id, created_at FROM finding_matches)) WHERE place <= 20""")
def newest(spark, d):
    """The twenty newest findings of each repository: a listing with a stated length."""
    m = table(spark, d, "finding_matches").select("repo_id", "match_id", "created_at").distinct()
    return m.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("created_at"), "match_id"))).where("place <= 20").select("repo_id", "match_id", "place")


@query("so2_all_analyzers", """
SELECT 'lockfile' AS source, count(*) AS findings FROM source_files WHERE regexp_extract(file_path, '[^/]*$') IN ('composer.lock', 'package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'Gemfile.lock', 'poetry.lock')
UNION ALL SELECT 'large_function', count(*) FROM symbols WHERE symbol_type IN ('function', 'method') AND line_end - line_start + 1 >= 80
UNION ALL SELECT 'controller', count(*) FROM source_files WHERE regexp_matches(lower(file_path), 'routes|controllers|handlers') AND (contains(content, 'SELECT ') OR contains(content, 'session.execute') OR contains(content, 'db.') OR contains(content, 'cursor.'))""")
def all_analyzers(spark, d):
    """Outputs of several analyzers as one bag."""
    f, s = table(spark, d, "source_files"), table(spark, d, "symbols")
    parts = [("lockfile", rules.file_findings(f).where("rule_id = 'dependency_lockfile_changed'")), ("large_function", rules.large_functions(s)), ("controller", rules.data_access_in_controllers(f))]
    out = None
    for name, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("findings")).select(F.lit(name).alias("source"), "findings")
        out = one if out is None else out.unionAll(one)
    return out


@query("d8_explanations", """
WITH m AS (SELECT DISTINCT match_id, title, severity, file_path, start_line, evidence.rule_trigger_reason AS reason FROM finding_matches)
SELECT match_id, title || ' (' || coalesce(severity, 'unknown') || ') in ' || file_path || coalesce(':' || start_line, '') || coalesce(' - ' || reason, '') AS explanation FROM m""")
def explanations(spark, d):
    m = table(spark, d, "finding_matches").select("match_id", "title", "severity", "file_path", "start_line", F.col("evidence.rule_trigger_reason").alias("reason")).distinct()
    said = F.concat("title", F.lit(" ("), F.coalesce("severity", F.lit("unknown")), F.lit(") in "), "file_path", F.coalesce(F.concat(F.lit(":"), F.col("start_line").cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(" - "), "reason"), F.lit("")))
    return m.select("match_id", said.alias("explanation"))


@query("pf12_code_share", f"""
SELECT repo_id, count(*) FILTER ({" OR ".join(f"ends_with(file_path, '{e}')" for e in X.CODE)}) AS code_files, count(*) AS files FROM source_files GROUP BY 1""")
def code_share(spark, d):
    return table(spark, d, "source_files").groupBy("repo_id").agg(F.count_if(X.is_code(F.col("file_path"))).alias("code_files"), F.count(F.lit(1)).alias("files"))
