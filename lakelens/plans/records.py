"""Records around findings and runs: explanations, advice, status, cost, optional filters, gates of events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import findings, graph, rules
from ..session import kept
from ..streaming import windows
from .findings import M, unique
from .graph import EDGES
from .registry import query, quoted, table
from .rules import SCAN

KINDS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in findings.SENSITIVITY.items())
HAS = lambda c, *words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@query("s1_explanations", f"""
WITH t AS (SELECT match_id, coalesce(tags, []) AS tags, lower(coalesce(evidence.rule_name, '')) AS n, lower(coalesce(evidence.code_snippet, '')) AS c FROM {M}),
f AS (SELECT *, CASE WHEN {HAS("c", "console.log", "print(", "log(", "logger.")} THEN 'logged' WHEN {HAS("c", "http", "api", "fetch", "axios", "requests.")} THEN 'third_party' WHEN {HAS("n", "secret", "key")} THEN 'direct' ELSE 'internal' END AS flow,
 coalesce(list_max(list_transform(tags, lambda t: CASE lower(t) {KINDS} ELSE 50 END)), 0) AS most, list_contains(tags, 'PII') OR list_contains(tags, 'health_data') OR list_contains(tags, 'student_data') AS personal FROM t),
l AS (SELECT *, CASE WHEN personal THEN list_filter([CASE WHEN list_contains(tags, 'health') OR contains(lower(array_to_string(tags, ',')), 'patient') THEN 'HIPAA' END, CASE WHEN list_contains(tags, 'student') OR contains(lower(array_to_string(tags, ',')), 'education') THEN 'FERPA' END,
 CASE WHEN list_contains(tags, 'PII') THEN 'GDPR' END, CASE WHEN list_contains(tags, 'PII') THEN 'CCPA' END], lambda x: x IS NOT NULL) ELSE [] END AS laws FROM f)
SELECT match_id, array_to_string(laws, ',') AS laws, concat_ws('; ', 'Data sensitivity: ' || CASE WHEN most >= 85 THEN 'high' WHEN most >= 60 THEN 'medium' ELSE 'low' END, CASE WHEN len(tags) > 0 THEN 'Data types: ' || array_to_string(tags, ', ') END, 'Flow: ' || flow, CASE WHEN len(laws) > 0 THEN 'Regulatory: ' || array_to_string(laws, ', ') END) AS explanation FROM l""")
def explanations(spark, d):
    """S1 and S2: the impact of each finding in words, with the laws it touches."""
    return findings.explained(unique(spark, d))


COVERAGE = "p AS (SELECT repo_id, avg(CASE WHEN coalesce(len(errors), 0) = 0 THEN 100.0 ELSE 0.0 END) AS pct FROM parse_results GROUP BY 1)"


def coverage(spark, d):
    return table(spark, d, "parse_results").groupBy("repo_id").agg(F.avg(F.when(F.size(F.coalesce("errors", F.array())) == 0, 100.0).otherwise(0.0)).alias("pct"))


@query("s6_rationales", f"""
WITH {COVERAGE} SELECT match_id, CASE WHEN confidence IN ('high', 'medium') THEN 'direct' ELSE 'heuristic' END AS evidence_strength, 'none' AS trace_strength, round(coalesce(pct, 0) / 100, 2) AS coverage_factor, 0.0::DOUBLE AS verification_factor FROM {M} LEFT JOIN p USING (repo_id)""")
def rationales(spark, d):
    j = unique(spark, d).join(coverage(spark, d), "repo_id", "left")
    return j.select("match_id", findings.rationale(F.col("confidence"), F.coalesce("pct", F.lit(0.0))).alias("r")).select("match_id", "r.*")


@query("s7_run_status", f"""
WITH {COVERAGE}, e AS (SELECT repo_id, count(*) AS n, count(*) FILTER (len(coalesce(errors, [])) > 0) AS broken FROM parse_results GROUP BY 1)
SELECT r.repo_id, array_to_string(list_filter([CASE WHEN pct < 80 THEN 'low_coverage' END, CASE WHEN broken > 0 THEN 'parse_errors' END], lambda x: x IS NOT NULL), ',') AS modes,
CASE WHEN r.index_status = 'failed' THEN 'failed' WHEN coalesce(pct, 100) < 80 OR coalesce(broken, 0) > 0 THEN 'degraded' ELSE 'completed' END AS status FROM repositories r LEFT JOIN p USING (repo_id) LEFT JOIN e USING (repo_id)""")
def status(spark, d):
    """Runs are degraded by low coverage or parse errors, failed where indexing failed."""
    p = table(spark, d, "parse_results").groupBy("repo_id").agg(F.avg(F.when(F.size(F.coalesce("errors", F.array())) == 0, 100.0).otherwise(0.0)).alias("pct"), F.count_if(F.size(F.coalesce("errors", F.array())) > 0).alias("broken"))
    j = table(spark, d, "repositories").select("repo_id", "index_status").join(p, "repo_id", "left")
    modes = F.array_compact(F.array(F.when(F.col("pct") < 80, "low_coverage"), F.when(F.col("broken") > 0, "parse_errors")))
    return j.select("repo_id", F.array_join(modes, ",").alias("modes"), findings.run_status(modes, F.coalesce(F.col("index_status") == "failed", F.lit(False))).alias("status"))


FIX = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in findings.FIXES.items()) + f" ELSE '{findings.NO_FIX}' END"


@query("s8_fixes", f"WITH r(category) AS (VALUES {', '.join(f"('{k}')" for k in findings.FIXES)}), a AS (SELECT category FROM r UNION SELECT DISTINCT category FROM {M}) SELECT category, {FIX} AS fix FROM a")
def fixes(spark, d):
    """Advice for every category that is known or occurs."""
    known = spark.createDataFrame([(k,) for k in findings.FIXES], "category string")
    return known.union(unique(spark, d).select("category")).distinct().select("category", findings.fix_of(F.col("category")).alias("fix"))


@query("f22_token_costs", """
WITH n AS (SELECT repo_id, sum(length(question)) // 4 AS given, sum(length(coalesce(answer_text, ''))) // 4 AS produced FROM qa_results GROUP BY 1), e AS (SELECT repo_id, sum(length(body)) // 4 AS embedded FROM symbols GROUP BY 1)
SELECT coalesce(n.repo_id, e.repo_id) AS repo_id, trunc((0.0::DOUBLE + coalesce(embedded, 0)::DOUBLE / 1000 * 0.00002::DOUBLE + coalesce(given, 0)::DOUBLE / 1000 * 0.0025::DOUBLE + coalesce(produced, 0)::DOUBLE / 1000 * 0.01::DOUBLE) * 10000)::BIGINT AS cost FROM n FULL JOIN e ON n.repo_id = e.repo_id""")
def token_costs(spark, d):
    """What the questions, answers and symbols of each repository would cost, four characters a token."""
    quarter = lambda c: F.floor(F.sum(F.length(c)) / 4)
    n = table(spark, d, "qa_results").groupBy("repo_id").agg(quarter(F.col("question")).alias("given"), quarter(F.coalesce("answer_text", F.lit(""))).alias("produced"))
    e = table(spark, d, "symbols").groupBy("repo_id").agg(quarter(F.col("body")).alias("embedded"))
    return n.join(e, "repo_id", "full").select("repo_id", findings.token_cost(F.col("embedded"), F.col("given"), F.col("produced")).alias("cost"))


WANTED = [(None, None, None), ("security", None, None), (None, "high", None), ("privacy", "medium", "low"), ("security", "critical", "high")]


@query("pf7_optional_filters", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {k} AS filter_no, count(*) AS findings FROM {M} WHERE true" + "".join(f" AND {c} = '{v}'" for c, v in zip(("category", "severity", "confidence"), w, strict=True) if v) for k, w in enumerate(WANTED)) + ")")
def optional_filters(spark, d):
    """Filters by category, severity and confidence, each of which may be left out."""
    out = None
    for k, w in enumerate(WANTED):
        one = findings.filtered(unique(spark, d), **dict(zip(("category", "severity", "confidence"), w, strict=True))).agg(F.count(F.lit(1)).alias("findings")).select(F.lit(k).alias("filter_no"), "findings")
        out = one if out is None else out.unionAll(one)
    return out


@query("pf13_enabled_rules", f"WITH m AS ({SCAN}) SELECT rule_id, count(*) AS files FROM m WHERE rule_id IN ({quoted(r.rule_id for r in rules.SCAN_RULES if r.category in ('security', 'performance'))}) GROUP BY 1")
def enabled_rules(spark, d):
    """Only the rules of two categories are compiled into the plan."""
    some = rules.enabled(rules.SCAN_RULES, ["security", "performance"])
    return rules.scan_findings(table(spark, d, "source_files"), some).select("rule_id", "snapshot_id").distinct().groupBy("rule_id").agg(F.count(F.lit(1)).alias("files"))


@query("tk8_controls", f"SELECT category AS control_id, count(*) AS findings, (row_number() OVER (ORDER BY category))::INTEGER AS place FROM {M} WHERE category IS NOT NULL GROUP BY 1")
def controls(spark, d):
    """Controls in the order of their ids; the window runs over categories, which are few."""
    g = unique(spark, d).where("category IS NOT NULL").groupBy(F.col("category").alias("control_id")).agg(F.count(F.lit(1)).alias("findings"))
    return g.withColumn("place", F.row_number().over(Window.orderBy("control_id")))


@query("tk11_symbol_names", "SELECT repo_id, symbol_name, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY symbol_name) AS place FROM (SELECT DISTINCT repo_id, symbol_name FROM symbols WHERE symbol_name IS NOT NULL)) WHERE place <= 30")
def symbol_names(spark, d):
    """The first thirty names of each repository in alphabetical order: an index page."""
    n = table(spark, d, "symbols").where("symbol_name IS NOT NULL").select("repo_id", "symbol_name").distinct()
    return n.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy("symbol_name"))).where("place <= 30")


@query("f4_stripped", """
SELECT repo_id, rtrim(full_name || '.git', '.git') AS stripped, regexp_replace(full_name || '.git', '\\.git$', '') AS cut, trim('\"''' || repo_name || '''\"', '\"''') AS bare, ltrim('..' || repo_name, '.') AS relative FROM repositories""")
def stripped(spark, d):
    """Sets of characters taken off the ends, which for `.git` takes more than the suffix, and the suffix alone."""
    full = F.concat("full_name", F.lit(".git"))
    return table(spark, d, "repositories").select("repo_id", X.strip_end(full, ".git").alias("stripped"), F.regexp_replace(full, r"\.git$", "").alias("cut"), X.strip_both(F.concat(F.lit("\"'"), "repo_name", F.lit("'\"")), "\"'").alias("bare"), X.strip_start(F.concat(F.lit(".."), "repo_name"), ".").alias("relative"))


#: Hooks made of events: their route, an action, a ref and a repository by numbers in them.
HOOKS = """h AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'installation' WHEN 'purchase' THEN 'push' WHEN 'view' THEN 'pull_request' WHEN 'click' THEN 'pull_request' ELSE 'other' END AS route,
 CASE event_id % 4 WHEN 0 THEN 'opened' WHEN 1 THEN 'synchronize' WHEN 2 THEN 'deleted' END AS action, 'refs/heads/' || CASE event_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'master' ELSE 'dev' END AS ref, CASE WHEN user_id % 60 < 50 THEN 'repo-' || lpad((user_id % 60)::VARCHAR, 3, '0') END AS repo_id FROM events)"""


def hooks(events):
    route = F.when(F.col("event_type") == "signup", "installation").when(F.col("event_type") == "purchase", "push").when(F.col("event_type").isin("view", "click"), "pull_request").otherwise("other")
    n = F.col("event_id")
    action = F.when(n % 4 == 0, "opened").when(n % 4 == 1, "synchronize").when(n % 4 == 2, "deleted")
    ref = F.concat(F.lit("refs/heads/"), F.when(n % 3 == 0, "main").when(n % 3 == 1, "master").otherwise("dev"))
    repo = F.when(F.col("user_id") % 60 < 50, F.concat(F.lit("repo-"), F.lpad((F.col("user_id") % 60).cast("string"), 3, "0")))
    return events.select("event_id", route.alias("route"), action.alias("action"), ref.alias("ref"), repo.alias("repo_id"))


OUTCOMES = f"""{HOOKS}, r AS (SELECT repo_id, default_branch, index_status, true AS connected FROM repositories WHERE deleted_at IS NULL), j AS (SELECT h.*, default_branch, index_status, connected FROM h LEFT JOIN r ON r.repo_id = h.repo_id),
w AS (SELECT *, CASE WHEN route = 'push' THEN CASE WHEN repo_id IS NULL THEN 'no repository id' WHEN connected IS NULL THEN 'repository not connected' WHEN NOT coalesce(ends_with(ref, '/' || default_branch), false) THEN 'not default branch' END
 WHEN route = 'pull_request' THEN CASE WHEN action IS NULL OR action NOT IN ('opened', 'synchronize') THEN 'action ' || coalesce(action, 'none') || ' not handled' WHEN repo_id IS NULL THEN 'no repository id' WHEN connected IS NULL THEN 'repository not connected' WHEN coalesce(index_status, '') <> 'ready' THEN 'repository not indexed' END
 WHEN route = 'installation' THEN CASE WHEN action IS NULL OR action NOT IN ('created', 'deleted') THEN 'action ' || coalesce(action, 'none') END ELSE 'ignored' END AS reason FROM j),
o AS (SELECT event_id, route, repo_id, CASE WHEN reason IS NULL THEN 'ok' ELSE 'ignored' END AS status, CASE WHEN reason IS NOT NULL THEN NULL WHEN route = 'push' THEN 'reindex_queued' WHEN route = 'pull_request' THEN 'review_queued' WHEN action = 'deleted' THEN 'uninstalled' ELSE 'installed' END AS outcome, reason FROM w)"""


@query("j21_gated_hooks", f"WITH {OUTCOMES} SELECT * FROM o")
def gated_hooks(spark, d):
    """ST1 to ST4: every event joined to its repository and passed through the gates."""
    return windows.gated(hooks(table(spark, d, "events")), table(spark, d, "repositories"))


@query("st3_queued_work", f"WITH {OUTCOMES} SELECT repo_id, outcome, count(*) AS events FROM o WHERE outcome IN ('reindex_queued', 'review_queued') GROUP BY 1, 2")
def queued_work(spark, d):
    return gated_hooks(spark, d).where(F.col("outcome").isin("reindex_queued", "review_queued")).groupBy("repo_id", "outcome").agg(F.count(F.lit(1)).alias("events"))


@query("st2_marked_deleted", f"WITH {OUTCOMES} SELECT repo_id, coalesce(r2.deleted_at, CASE WHEN repo_id IN (SELECT repo_id FROM o WHERE outcome = 'uninstalled') THEN TIMESTAMP '2024-06-01' END) AS deleted_at FROM repositories r2")
def marked_deleted(spark, d):
    """Repositories after the end of some installations."""
    r = table(spark, d, "repositories")
    return windows.without_deleted(r, gated_hooks(spark, d), F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")).select("repo_id", "deleted_at")


@query("st11_newest_analyses", "SELECT qa_id, repo_id, created_at FROM qa_results ORDER BY created_at DESC, qa_id LIMIT 10")
def newest_analyses(spark, d):
    """What a cache of ten analyses holds that drops the oldest: the bound is the feature."""
    return table(spark, d, "qa_results").select("qa_id", "repo_id", "created_at").orderBy(F.desc("created_at"), "qa_id").limit(10)


@query("sc8_expired", "WITH n AS (SELECT repo_id, max(ingested_at) AS newest FROM source_files GROUP BY 1), t AS (SELECT max(newest) AS as_of FROM n) SELECT repo_id, newest FROM n, t WHERE newest < as_of - INTERVAL 1 DAY")
def expired(spark, d):
    """Repositories that nothing was loaded for within a day of the last load of all."""
    n = table(spark, d, "source_files").groupBy("repo_id").agg(F.max("ingested_at").alias("newest"))
    as_of = F.max("newest").over(Window.partitionBy())  # over repositories, which are few
    return n.withColumn("as_of", as_of).where(F.col("newest") < F.col("as_of") - F.expr("INTERVAL 1 DAY")).select("repo_id", "newest")


@query("g4_partial_callers", f"""
WITH {EDGES}, q AS (SELECT DISTINCT repo_id, callee AS wanted FROM edges UNION SELECT DISTINCT repo_id, file_path AS wanted FROM symbols WHERE file_path IS NOT NULL),
x AS (SELECT q.repo_id, wanted, e.caller, true AS is_exact FROM q JOIN edges e ON e.repo_id = q.repo_id AND e.callee = q.wanted),
p AS (SELECT q.repo_id, wanted, e.caller FROM q JOIN edges e ON e.repo_id = q.repo_id AND contains(e.callee, q.wanted) WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.repo_id = q.repo_id AND x.wanted = q.wanted))
SELECT repo_id, wanted, count(DISTINCT caller) AS callers, is_exact FROM (SELECT * FROM x UNION ALL SELECT repo_id, wanted, caller, false FROM p) GROUP BY ALL""")
def partial_callers(spark, d):
    """Callers of symbols by their full name, and for names that nobody calls, of symbols that begin with them: here the names are symbols and paths."""
    e = kept(graph.call_edges(table(spark, d, "symbols")))  # read five times
    wanted = e.select("repo_id", F.col("callee").alias("wanted")).union(table(spark, d, "symbols").where("file_path IS NOT NULL").select("repo_id", "file_path")).distinct()
    return graph.callers_of(e, wanted).groupBy("repo_id", "wanted", "is_exact").agg(F.count("caller").alias("callers"))  # edges and names are distinct, so callers are
