from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph
from .graph import IMPORTS
from .registry import query, quoted, table
from .rules import REDACT


@query("pf17_repository_search", """
SELECT repo_id, full_name, index_status FROM repositories WHERE (contains(lower(repo_name), 'chunk') OR contains(lower(owner_name), 'harbor') OR contains(lower(full_name), 'load')) AND index_status <> 'failed'""")
def repository_search(spark, d):
    """A text in any of three columns, case aside, with a facet."""
    hit = F.lower("repo_name").contains("chunk") | F.lower("owner_name").contains("harbor") | F.lower("full_name").contains("load")
    return table(spark, d, "repositories").where(hit & (F.col("index_status") != "failed")).select("repo_id", "full_name", "index_status")


@query("tk9_shallow_paths", """
WITH p AS (SELECT DISTINCT repo_id, file_path, len(string_split(file_path, '/')) AS depth FROM source_files)
SELECT repo_id, file_path, depth::INTEGER AS depth, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY depth, file_path) AS place FROM p) WHERE place <= 15""")
def shallow(spark, d):
    """The fifteen shallowest paths of each repository: a listing with a stated length."""
    p = table(spark, d, "source_files").select("repo_id", "file_path", F.size(F.split("file_path", "/")).alias("depth")).distinct()
    return p.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy("depth", "file_path"))).where("place <= 15")


@query("f18_permalinks", """
SELECT DISTINCT m.match_id, r.full_name || '/blob/' || r.default_branch || '/' || m.file_path || '#L' || m.start_line || '-L' || greatest(m.start_line, m.end_line) AS link, regexp_extract(r.full_name, '^([^/]+)/', 1) AS owner FROM finding_matches m JOIN repositories r USING (repo_id) WHERE m.start_line IS NOT NULL AND m.end_line IS NOT NULL""")
def permalinks(spark, d):
    r = table(spark, d, "repositories").select("repo_id", "full_name", "default_branch")
    m = table(spark, d, "finding_matches").where("start_line IS NOT NULL AND end_line IS NOT NULL").join(r, "repo_id")
    link = F.concat("full_name", F.lit("/blob/"), "default_branch", F.lit("/"), "file_path", F.lit("#L"), F.col("start_line").cast("string"), F.lit("-L"), F.greatest("start_line", "end_line").cast("string"))
    return m.select("match_id", link.alias("link"), F.regexp_extract("full_name", "^([^/]+)/", 1).alias("owner")).distinct()


@query("j19_source_symbols", """
WITH s AS (SELECT snapshot_id, symbol_name, min(symbol_id) AS symbol_id FROM symbols GROUP BY 1, 2)
SELECT r.source_row_id, r.symbol_name, s.symbol_id FROM retrieved_sources r LEFT JOIN s ON s.snapshot_id = r.snapshot_id AND s.symbol_name = r.symbol_name""")
def source_symbols(spark, d):
    """Each retrieved source with the symbol of that name in its file, if there is one."""
    s = table(spark, d, "symbols").groupBy("snapshot_id", "symbol_name").agg(F.min("symbol_id").alias("symbol_id"))
    return table(spark, d, "retrieved_sources").join(s, ["snapshot_id", "symbol_name"], "left").select("source_row_id", "symbol_name", "symbol_id")


@query("j14_unretrieved_symbols", """
SELECT repo_id, count(*) AS symbols FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM retrieved_sources r WHERE r.snapshot_id = s.snapshot_id AND r.symbol_name = s.symbol_name) GROUP BY 1""")
def unretrieved(spark, d):
    r = table(spark, d, "retrieved_sources").select("snapshot_id", "symbol_name")
    return table(spark, d, "symbols").join(r, ["snapshot_id", "symbol_name"], "left_anti").groupBy("repo_id").agg(F.count(F.lit(1)).alias("symbols"))


@query("v8_snippets", """
SELECT source_row_id, CASE WHEN content IS NULL OR content = '' THEN '[no content for ' || file_path || ']' WHEN length(content) > 500 THEN left(content, 500) || '...' ELSE content END AS snippet FROM retrieved_sources""")
def snippets(spark, d):
    c = F.col("content")
    return table(spark, d, "retrieved_sources").select("source_row_id", F.when(c.isNull() | (c == ""), F.concat(F.lit("[no content for "), "file_path", F.lit("]"))).otherwise(X.cap(c, 500)).alias("snippet"))


@query("a9_formatted_references", """
SELECT q.qa_id, string_agg('[' || r.source_index || '] ' || r.file_path || coalesce(':' || r.start_line, ''), chr(10) ORDER BY r.source_index, r.source_row_id) AS refs FROM qa_results q JOIN retrieved_sources r USING (qa_id) GROUP BY 1""")
def references(spark, d):
    r = table(spark, d, "retrieved_sources")
    line = F.concat(F.lit("["), F.col("source_index").cast("string"), F.lit("] "), "file_path", F.coalesce(F.concat(F.lit(":"), F.col("start_line").cast("string")), F.lit("")))
    g = r.select("qa_id", "source_index", "source_row_id", line.alias("line")).join(table(spark, d, "qa_results").select("qa_id"), "qa_id", "left_semi").groupBy("qa_id").agg(F.array_sort(F.collect_list(F.struct("source_index", "source_row_id", "line"))).alias("l"))
    return g.select("qa_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("refs"))


@query("d7_import_listing", f"WITH {IMPORTS}, u AS (SELECT DISTINCT repo_id, file_path, module FROM imp) SELECT repo_id, file_path, array_to_string(list_sort(list(module))[:3], ', ') AS modules, count(*) AS n FROM u GROUP BY 1, 2")
def import_listing(spark, d):
    u = graph.imports(table(spark, d, "source_files")).select("repo_id", "file_path", "module").distinct()
    return u.groupBy("repo_id", "file_path").agg(F.array_join(F.slice(F.array_sort(F.collect_list("module")), 1, 3), ", ").alias("modules"), F.count(F.lit(1)).alias("n"))


@query("ag25_review_stats", """
WITH m AS (SELECT DISTINCT match_id, scan_run_id, severity, file_path FROM finding_matches)
SELECT scan_run_id, count(*) AS findings_count, count(*) FILTER (severity = 'critical') AS critical_count, count(DISTINCT file_path) AS files_changed FROM m GROUP BY 1""")
def review_stats(spark, d):
    m = table(spark, d, "finding_matches").dropDuplicates(["match_id"])
    return m.groupBy("scan_run_id").agg(F.count(F.lit(1)).alias("findings_count"), F.count_if(F.col("severity") == "critical").alias("critical_count"), F.countDistinct("file_path").alias("files_changed"))


@query("ag17_totals", """
WITH m AS (SELECT DISTINCT match_id, snapshot_id, severity FROM finding_matches), f AS (SELECT snapshot_id, count(*) AS n, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS w FROM m GROUP BY 1)
SELECT count(*) AS files, count(f.n) AS with_findings, coalesce(sum(f.c), 0)::BIGINT AS critical, coalesce(sum(f.w), 0)::BIGINT AS high FROM source_files s LEFT JOIN f USING (snapshot_id)""")
def totals(spark, d):
    m = table(spark, d, "finding_matches").dropDuplicates(["match_id"])
    f = m.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "critical").alias("c"), F.count_if(F.col("severity") == "high").alias("w"))
    return table(spark, d, "source_files").select("snapshot_id").join(f, "snapshot_id", "left").agg(F.count(F.lit(1)).alias("files"), F.count("n").alias("with_findings"), F.coalesce(F.sum("c"), F.lit(0)).alias("critical"), F.coalesce(F.sum("w"), F.lit(0)).alias("high"))


@query("st8_new_runs", """
SELECT scan_run_id, count(*) AS files FROM source_files s WHERE NOT EXISTS (SELECT 1 FROM finding_matches m WHERE m.scan_run_id = s.scan_run_id) GROUP BY 1""")
def new_runs(spark, d):
    """Runs that have stored no findings yet: the anti-join before an append."""
    return table(spark, d, "source_files").join(table(spark, d, "finding_matches").select("scan_run_id"), "scan_run_id", "left_anti").groupBy("scan_run_id").agg(F.count(F.lit(1)).alias("files"))


@query("so4_unknown_ids", """
WITH k AS (SELECT qa_id, list(DISTINCT source_index) AS known FROM retrieved_sources GROUP BY 1),
q AS (SELECT qa_id, list_distinct(list_transform(quoted_spans, lambda s: s.source_id)) AS cited FROM qa_results WHERE len(quoted_spans) > 0)
SELECT q.qa_id, len(list_filter(cited, lambda x: NOT list_contains(coalesce(known, []), x)))::INTEGER AS unknown_ids FROM q LEFT JOIN k USING (qa_id)""")
def unknown_ids(spark, d):
    k = table(spark, d, "retrieved_sources").groupBy("qa_id").agg(F.collect_set("source_index").alias("known"))
    q = table(spark, d, "qa_results").where(F.size("quoted_spans") > 0).select("qa_id", F.array_distinct(F.filter(F.col("quoted_spans.source_id"), lambda x: x.isNotNull())).alias("cited"))
    return q.join(k, "qa_id", "left").select("qa_id", F.size(F.array_except("cited", F.coalesce("known", F.array().cast("array<int>")))).alias("unknown_ids"))


@query("f29_visibility", "SELECT CASE WHEN starts_with(symbol_name, '__') AND ends_with(symbol_name, '__') THEN 'magic' WHEN starts_with(symbol_name, '__') THEN 'private' WHEN starts_with(symbol_name, '_') THEN 'protected' ELSE 'public' END AS visibility, count(*) AS symbols FROM symbols GROUP BY 1")
def visibilities(spark, d):
    n = F.col("symbol_name")
    v = F.when(n.startswith("__") & n.endswith("__"), "magic").when(n.startswith("__"), "private").when(n.startswith("_"), "protected").otherwise("public")
    return table(spark, d, "symbols").groupBy(v.alias("visibility")).agg(F.count(F.lit(1)).alias("symbols"))


@query("f12_redacted_snippets", f"WITH m AS (SELECT DISTINCT match_id, snippet AS t FROM finding_matches) SELECT match_id, {REDACT} AS snippet FROM m")
def redacted(spark, d):
    """Every snippet through all token shapes."""
    m = table(spark, d, "finding_matches").select("match_id", "snippet").distinct()
    return m.select("match_id", X.redact_tokens(F.col("snippet")).alias("snippet"))


@query("g9_symbol_search", f"""
WITH t AS (SELECT symbol_id, repo_id, qualified_name, row_number() OVER (PARTITION BY repo_id ORDER BY symbol_id) AS place FROM symbols WHERE symbol_type IN ({quoted(['method'])}) AND contains(file_path, 'services') AND contains(lower(symbol_name), 'quota'))
SELECT symbol_id, repo_id, qualified_name, place::INTEGER AS place FROM t WHERE place <= 20""")
def symbol_search(spark, d):
    """The first twenty methods of each repository by part of name and path: a search with a stated limit."""
    s = table(spark, d, "symbols").where((F.col("symbol_type") == "method") & F.col("file_path").contains("services") & F.lower("symbol_name").contains("quota"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy("symbol_id"))).where("place <= 20").select("symbol_id", "repo_id", "qualified_name", "place")

