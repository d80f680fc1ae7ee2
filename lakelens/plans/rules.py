from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import rules
from .registry import query, quoted, table


def sql_text(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


CODE = " OR ".join(f"ends_with(file_path, '{e}')" for e in X.CODE)
UNSCANNED = " OR ".join(f"contains(lower(file_path), '{p}')" for p in rules.UNSCANNED)
LINES = "SELECT snapshot_id, repo_id, file_path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INTEGER AS line_no FROM source_files"
LINE_RULES = ", ".join(f"('{r.rule_id}', {sql_text(r.pattern)}, '{r.severity}', '{r.category}')" for r in rules.LINE_RULES)
MASK = "CASE WHEN length(h) > 12 THEN h[:4] || repeat('*', length(h) - 8) || right(h, 4) ELSE h[:2] || repeat('*', length(h) - 2) END"


@query("r1_secret_lines", f"""
WITH l AS ({LINES} WHERE NOT ({UNSCANNED})), r(rule_id, pattern, severity, category) AS (VALUES {LINE_RULES}),
m AS (SELECT l.*, r.rule_id, r.severity, r.category, regexp_extract(line, r.pattern) AS h FROM l, r WHERE regexp_matches(line, r.pattern))
SELECT snapshot_id, repo_id, file_path, line_no, rule_id, severity, category, {MASK} AS hit, replace(line, h, {MASK}) AS line FROM m""")
def secret_lines(spark, d):
    return rules.secret_lines(table(spark, d, "source_files")).select("snapshot_id", "repo_id", "file_path", "line_no", "rule_id", "severity", "category", "hit", "line")


@query("w6_secret_context", f"""
WITH f AS (SELECT snapshot_id, string_split(content, chr(10)) AS lines FROM source_files WHERE NOT ({UNSCANNED})), r(rule_id, pattern, severity, category) AS (VALUES {LINE_RULES}),
l AS (SELECT snapshot_id, lines, unnest(lines) AS line, generate_subscripts(lines, 1)::INTEGER AS n FROM f),
m AS (SELECT l.*, r.rule_id, regexp_extract(line, r.pattern) AS h FROM l, r WHERE regexp_matches(line, r.pattern))
SELECT snapshot_id, n AS line_no, rule_id, replace(array_to_string(list_transform(range(greatest(n - 3, 1), least(n + 3, len(lines)) + 1), lambda i: (CASE WHEN i = n THEN '>>> ' ELSE '    ' END) || lpad(i::VARCHAR, 4, ' ') || ' | ' || lines[i]), chr(10)), h, {MASK}) AS context_lines FROM m""")
def secret_context(spark, d):
    return rules.secret_lines(table(spark, d, "source_files")).select("snapshot_id", "line_no", "rule_id", "context_lines")


@query("r10_file_names", f"""
WITH f AS (SELECT snapshot_id, repo_id, file_path, regexp_extract(file_path, '[^/]*$') AS name FROM source_files)
SELECT snapshot_id, repo_id, file_path, rule_id, severity FROM (
SELECT f.*, 'file_env_committed' AS rule_id, 'critical' AS severity FROM f WHERE regexp_matches(name, '^\\.env$')
UNION ALL SELECT f.*, 'file_env_config_committed', 'critical' FROM f WHERE regexp_matches(name, '^\\.env\\.(local|production|staging)$')
UNION ALL SELECT f.*, 'file_ssh_key_committed', 'critical' FROM f WHERE regexp_matches(name, 'id_rsa$|id_ed25519$|id_ecdsa$')
UNION ALL SELECT f.*, 'dependency_lockfile_changed', 'info' FROM f WHERE name IN ({quoted(rules.LOCKFILES)}))""")
def file_names(spark, d):
    return rules.file_findings(table(spark, d, "source_files"))


SCAN = " UNION ALL ".join(
    f"SELECT snapshot_id, repo_id, file_path, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, content, {sql_text(r.pattern)} AS p, regexp_extract_all(content, {sql_text(r.pattern)}) AS ms, regexp_split_to_array(content, {sql_text(r.pattern)}) AS segs FROM source_files WHERE regexp_matches(content, {sql_text(r.pattern)})"
    for r in rules.SCAN_RULES
)


@query("r14_scan_offsets", f"""
WITH m AS ({SCAN}), e AS (SELECT snapshot_id, repo_id, file_path, rule_id, severity, ms, segs, unnest(range(1, len(ms) + 1)) AS i FROM m),
b AS (SELECT *, array_to_string(segs[:i], '') || array_to_string(ms[:i - 1], '') AS before FROM e)
SELECT snapshot_id, repo_id, file_path, rule_id, severity, (1 + length(before) - length(replace(before, chr(10), '')))::INTEGER AS start_line FROM b""")
def scan_offsets(spark, d):
    return rules.scan_findings(table(spark, d, "source_files")).select("snapshot_id", "repo_id", "file_path", "rule_id", "severity", "start_line")


MIGRATION = " UNION ALL ".join(f"SELECT snapshot_id, line_no, '{r.rule_id}' AS rule_id, regexp_extract(line, {sql_text(r.pattern)}, 1) AS target FROM l WHERE regexp_matches(line, {sql_text(r.pattern)})" for r in rules.MIGRATION_RULES)


MIGRATED = "SELECT snapshot_id, CASE WHEN snapshot_id % 3 < 2 THEN 'database/Migrations/' ELSE '' END || file_path AS file_path, content || chr(10) || 'Schema::dropIfExists(''t_' || substring(sha256(file_path), 1, 6) || ''');' || chr(10) || '$table->renameColumn(''a'', ''b'');' AS content FROM source_files"


@query("r12_migrations", f"""
WITH f AS (SELECT * FROM ({MIGRATED}) WHERE contains(lower(file_path), 'migrations/') AND ends_with(file_path, '.php')),
l AS (SELECT snapshot_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INTEGER AS line_no FROM f) {MIGRATION}""")
def migrations(spark, d):
    """The tables hold no migrations, so two files of three are taken for some, and all get two destructive lines behind their own."""
    tail = F.concat(F.lit("\nSchema::dropIfExists('t_"), F.substring(F.sha2("file_path", 256), 1, 6), F.lit("');\n$table->renameColumn('a', 'b');"))
    f = table(spark, d, "source_files").withColumn("content", F.concat("content", tail)).withColumn("file_path", F.concat(F.when(F.col("snapshot_id") % 3 < 2, "database/Migrations/").otherwise(""), "file_path"))
    return rules.migration_findings(f).select("snapshot_id", "line_no", "rule_id", F.col("hit").alias("target"))


@query("r13_auth_removed", f"""
WITH r AS (SELECT snapshot_id, CASE WHEN snapshot_id % 4 < 3 THEN 'routes/' ELSE '' END || file_path AS file_path, content || chr(10) || 'Route::get("/x")->withoutMiddleware("' || (CASE WHEN length(file_path) % 2 = 0 THEN 'Auth' ELSE 'throttle' END) || '");' AS content FROM source_files),
f AS (SELECT * FROM r WHERE contains(lower(file_path), 'routes/') AND ends_with(file_path, '.php')),
l AS (SELECT snapshot_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INTEGER AS line_no FROM f)
SELECT snapshot_id, line_no, regexp_extract(line, {sql_text(rules.AUTH_RULE.pattern)}, 1) AS middleware FROM l WHERE regexp_matches(line, {sql_text(rules.AUTH_RULE.pattern)})""")
def auth_removed(spark, d):
    """Three files of four are taken for route files, and all get a route without its check behind their own text."""
    tail = F.concat(F.lit('\nRoute::get("/x")->withoutMiddleware("'), F.when(F.length("file_path") % 2 == 0, "Auth").otherwise("throttle"), F.lit('");'))
    f = table(spark, d, "source_files").withColumn("content", F.concat("content", tail)).withColumn("file_path", F.concat(F.when(F.col("snapshot_id") % 4 < 3, "routes/").otherwise(""), "file_path"))
    return rules.removed_access_checks(f).select("snapshot_id", "line_no", F.col("hit").alias("middleware"))


@query("r21_untimed_requests", """
WITH t AS (SELECT snapshot_id, file_path, content || chr(10) || 'requests.get(u, timeout=3)' || chr(10) || '  requests.post(u)' AS content FROM source_files),
l AS (SELECT snapshot_id, file_path, unnest(string_split(c, chr(10))) AS line, generate_subscripts(string_split(c, chr(10)), 1)::INTEGER AS line_no FROM (SELECT snapshot_id, file_path, regexp_replace(content, '\\r\\n?', chr(10), 'g') AS c FROM t))
SELECT snapshot_id, file_path, line_no, trim(line) AS snippet FROM l WHERE contains(line, 'requests.') AND contains(line, '(') AND NOT contains(line, 'timeout=')""")
def untimed(spark, d):
    """Files of every kind, each with one call that has a timeout and one that has none behind its own text."""
    f = table(spark, d, "source_files").withColumn("content", F.concat("content", F.lit("\nrequests.get(u, timeout=3)\n  requests.post(u)")))
    return rules.untimed_requests(f)


@query("r22_large_functions", """
SELECT symbol_id, file_path, qualified_name, line_end - line_start + 1 AS n_lines FROM symbols WHERE symbol_type IN ('function', 'method') AND line_end - line_start + 1 >= 80""")
def large(spark, d):
    return rules.large_functions(table(spark, d, "symbols")).drop("snippet")


@query("r23_controller_data_access", """
SELECT snapshot_id, file_path, 1 AS line_no FROM source_files WHERE regexp_matches(lower(file_path), 'routes|controllers|handlers')
AND (contains(content, 'SELECT ') OR contains(content, 'session.execute') OR contains(content, 'db.') OR contains(content, 'cursor.'))""")
def controllers(spark, d):
    return rules.data_access_in_controllers(table(spark, d, "source_files"))


def plain(p: str) -> str:
    """Look-ahead is not known to every engine; these two say the same without it."""
    return {r"http://(?!localhost|127\.0\.0\.1)": r"http://($|[^l1]|l($|[^o])|1($|[^2]))", "full_card|card_number(?!_last4|_token)": "full_card|card_number($|[^_]|_($|[^lt]))"}.get(p, p)


FORBIDDEN = " UNION ALL ".join(f"SELECT snapshot_id, file_path, line_no, '{c.check_id}' AS check_id, {k} AS pattern_no FROM l WHERE regexp_matches(line, {sql_text('(?i)' + plain(p))})" for c in rules.CHECKS for k, p in enumerate(c.forbidden))


@query("r24_forbidden_lines", f"WITH l AS ({LINES} WHERE {CODE}) {FORBIDDEN}")
def forbidden(spark, d):
    return rules.forbidden_lines(table(spark, d, "source_files"))


def _missing() -> str:
    out = []
    for c in rules.CHECKS:
        if c.patterns and c.required:
            lacks = " AND ".join(f"NOT regexp_matches(content, {sql_text('(?i)' + p)})" for p in c.required)
            out += [f"SELECT snapshot_id, file_path, '{c.check_id}' AS check_id, {k} AS pattern_no, min(line_no) AS line_no FROM l WHERE regexp_matches(line, {sql_text('(?i)' + p)}) AND snapshot_id IN (SELECT snapshot_id FROM source_files WHERE {lacks}) GROUP BY 1, 2" for k, p in enumerate(c.patterns)]
    return " UNION ALL ".join(out)


@query("r25_missing_required", f"WITH l AS ({LINES} WHERE {CODE}) {_missing()}")
def missing(spark, d):
    return rules.missing_required(table(spark, d, "source_files"))


REDACT = "t"
for _p in X.TOKENS:
    REDACT = f"regexp_replace({REDACT}, {sql_text(_p)}, '[REDACTED]', 'g')"


@query("w7_evidence_snippets", f"""
WITH m AS (SELECT DISTINCT match_id, snapshot_id, start_line, end_line FROM finding_matches WHERE start_line IS NOT NULL AND end_line IS NOT NULL),
f AS (SELECT m.*, string_split(s.content, chr(10)) AS lines FROM m JOIN source_files s USING (snapshot_id)),
c AS (SELECT match_id, start_line, end_line, array_to_string(lines[greatest(start_line, 1) : greatest(start_line, 1) + least(12, greatest(0, least(end_line, len(lines)) - greatest(start_line, 1) + 1)) - 1], chr(10)) AS t FROM f)
SELECT match_id, CASE WHEN length({REDACT}) > 800 THEN left({REDACT}, 800) || '...' ELSE {REDACT} END AS snippet FROM c""")
def evidence(spark, d):
    """Up to twelve lines of the file under each finding, redacted and capped at 800 characters."""
    m = table(spark, d, "finding_matches").select("match_id", "snapshot_id", "start_line", "end_line").distinct().where("start_line IS NOT NULL AND end_line IS NOT NULL")
    f = m.join(table(spark, d, "source_files").select("snapshot_id", X.lines_nl(F.col("content")).alias("lines")), "snapshot_id")
    first = F.greatest(F.col("start_line"), F.lit(1))
    n = F.least(F.lit(12), F.greatest(F.lit(0), F.least(F.col("end_line"), F.size("lines")) - first + 1))
    cut = X.redact_tokens(F.array_join(F.slice("lines", first, n), "\n"))
    return f.select("match_id", X.cap(cut, 800).alias("snippet"))


REQUESTS = "SELECT region, sector FROM (SELECT unnest(['eu', 'us', 'india', 'brazil', 'singapore', 'global', 'mars']) AS region), (SELECT unnest(['all', 'healthcare', 'finance', 'saas', 'ecommerce', 'education']) AS sector)"
_RULES = ", ".join(f"('{c}', [{quoted(r.split())}], [{quoted(s.split())}])" for c, r, s in rules.REGULATIONS)
REGULATED = f"q AS ({REQUESTS}), g(code, regions, sectors) AS (VALUES {_RULES}), a AS (SELECT region, sector, code FROM q, g WHERE (list_contains(regions, region) OR list_contains(regions, 'global') OR region = 'global') AND (list_contains(sectors, sector) OR list_contains(sectors, 'all')))"


def requests(spark):
    regions, sectors = ("eu", "us", "india", "brazil", "singapore", "global", "mars"), ("all", "healthcare", "finance", "saas", "ecommerce", "education")
    return spark.createDataFrame([(r, s) for r in regions for s in sectors], "region string, sector string")


@query("j7_regulations", f"WITH {REGULATED} SELECT * FROM a")
def regulations(spark, d):
    """Regulations that hold in each of some regions and sectors."""
    return rules.applicable_regulations(requests(spark))


_MEMBERS = ", ".join(f"('{k}', '{c}')" for k, codes in rules.CHECK_REGULATIONS.items() for c in codes.split())


@query("j8_checks_of_regulations", f"WITH {REGULATED}, m(check_id, code) AS (VALUES {_MEMBERS}) SELECT DISTINCT region, sector, check_id FROM a JOIN m USING (code)")
def checks_of_regulations(spark, d):
    return rules.applicable_checks(rules.applicable_regulations(requests(spark)), ["region", "sector"])


@query("r27_findings_by_regulation", f"""
WITH l AS ({LINES} WHERE {CODE}), f AS ({FORBIDDEN}), m(check_id, code) AS (VALUES {_MEMBERS}) SELECT code, check_id, count(DISTINCT snapshot_id) AS files, count(*) AS lines FROM f JOIN m USING (check_id) GROUP BY 1, 2""")
def by_regulation(spark, d):
    """Forbidden lines under every regulation that their check belongs to."""
    found = rules.forbidden_lines(table(spark, d, "source_files")).groupBy("check_id", "snapshot_id").agg(F.count(F.lit(1)).alias("lines"))
    members = spark.createDataFrame([(k, c) for k, codes in rules.CHECK_REGULATIONS.items() for c in codes.split()], "check_id string, code string")
    return found.groupBy("check_id").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines")).join(members, "check_id").select("code", "check_id", "files", "lines")
