from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph
from .registry import query, table

EDGES = r"""own AS (SELECT * FROM symbols WHERE symbol_type IN ('function', 'method')),
def AS (SELECT repo_id, symbol_name, min(qualified_name) AS callee FROM own GROUP BY 1, 2),
cal AS (SELECT DISTINCT repo_id, qualified_name AS caller, symbol_name AS self, unnest(regexp_extract_all(body, '\b([A-Za-z_]\w*)\s*\(', 1)) AS n FROM own),
edges AS (SELECT DISTINCT c.repo_id, c.caller, d.callee FROM cal c JOIN def d ON d.repo_id = c.repo_id AND d.symbol_name = c.n WHERE c.n <> c.self)"""


def edges(spark, d):
    return graph.call_edges(table(spark, d, "symbols"))


@query("g1_call_edges", f"WITH {EDGES} SELECT * FROM edges")
def call_edges(spark, d):
    return edges(spark, d)


@query("g4_callers", f"WITH {EDGES}, n AS (SELECT repo_id, callee, count(*) AS callers FROM edges GROUP BY 1, 2) SELECT e.repo_id, e.callee AS qualified_name, n.callers, e.caller FROM edges e JOIN n USING (repo_id, callee)")
def callers(spark, d):
    """Callers of each symbol, one row each beside their number, so no hub gathers all of its callers in one row."""
    e = edges(spark, d)
    n = e.groupBy("repo_id", "callee").agg(F.count(F.lit(1)).alias("callers"))
    return e.join(n, ["repo_id", "callee"]).select("repo_id", F.col("callee").alias("qualified_name"), "callers", "caller")


@query("g5_callees", f"WITH {EDGES} SELECT repo_id, caller AS qualified_name, count(DISTINCT callee) AS callees FROM edges GROUP BY 1, 2")
def callees(spark, d):
    return edges(spark, d).groupBy("repo_id", F.col("caller").alias("qualified_name")).agg(F.countDistinct("callee").alias("callees"))


@query("ag21_in_degree", f"""
WITH {EDGES}, c AS (SELECT repo_id, callee, count(*) AS n FROM edges GROUP BY 1, 2)
SELECT repo_id, callee, n, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, callee) AS place FROM c) WHERE place <= 10""")
def in_degree(spark, d):
    c = edges(spark, d).groupBy("repo_id", "callee").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("n"), "callee"))).where("place <= 10")


@query("g8_entry_points", f"""
WITH {EDGES}, m AS (SELECT repo_id, qualified_name, symbol_name, lower(coalesce(body, '')) AS b FROM own)
SELECT DISTINCT repo_id, qualified_name FROM m WHERE ({" OR ".join(f"contains(b, '{x}')" for x in graph.ROUTE_MARKS)})
OR (({" OR ".join(f"contains(lower(symbol_name), '{x}')" for x in graph.ENTRY_WORDS)}) AND (symbol_name IN ('main', '__main__', 'app') OR NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = m.repo_id AND e.callee = m.qualified_name)))""")
def entry_points(spark, d):
    return graph.entry_points(table(spark, d, "symbols"), edges(spark, d))


@query("g7_traces", f"""
WITH RECURSIVE {EDGES},
b AS (SELECT repo_id, caller, callee FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, caller ORDER BY callee) AS place FROM edges) WHERE place <= 10),
r AS (SELECT e.repo_id, [e.caller, e.callee] AS path, 1 AS n FROM b e WHERE e.caller NOT IN (SELECT callee FROM edges x WHERE x.repo_id = e.repo_id)
 UNION ALL SELECT r.repo_id, list_append(r.path, e.callee), r.n + 1 FROM r JOIN b e ON e.repo_id = r.repo_id AND e.caller = r.path[-1] WHERE r.n < 5 AND NOT list_contains(r.path, e.callee))
SELECT repo_id, array_to_string(path, ' -> ') AS chain FROM r WHERE NOT EXISTS (SELECT 1 FROM b e WHERE e.repo_id = r.repo_id AND e.caller = r.path[-1])""")
def traces(spark, d):
    """Call chains from symbols that nobody calls to symbols that call nobody, up to five calls long, ten ways from each symbol."""
    e = edges(spark, d)
    starts = e.select("repo_id", F.col("caller").alias("qualified_name")).distinct().join(e.select("repo_id", F.col("callee").alias("qualified_name")).distinct(), ["repo_id", "qualified_name"], "left_anti")
    return graph.traces(e, starts).select("repo_id", F.array_join("path", " -> ").alias("chain"))


@query("tk5_top_symbols", f"""
WITH {EDGES}, w AS (SELECT repo_id, callee AS qualified_name, count(*) AS n FROM edges GROUP BY 1, 2),
b AS (SELECT repo_id, qualified_name, 'class' AS kind, coalesce(len(children), 0)::BIGINT AS weight FROM symbols WHERE symbol_type = 'class' AND parent IS NULL
 UNION ALL SELECT s.repo_id, s.qualified_name, 'function', coalesce(w.n, 0) FROM symbols s LEFT JOIN w ON w.repo_id = s.repo_id AND w.qualified_name = s.qualified_name WHERE symbol_type = 'function' AND parent IS NULL),
g AS (SELECT repo_id, qualified_name, kind, max(weight) AS weight FROM b GROUP BY 1, 2, 3)
SELECT repo_id, qualified_name, kind, weight, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, kind ORDER BY weight DESC, qualified_name) AS place FROM g) WHERE place <= 10""")
def top_symbols(spark, d):
    return graph.top_symbols(table(spark, d, "symbols"), edges(spark, d))


IMPORTS = r"""l AS (SELECT snapshot_id, repo_id, file_path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INTEGER AS line_no FROM source_files WHERE regexp_matches(file_path, '\.(py|js|ts)$')),
i AS (SELECT snapshot_id, repo_id, file_path, line_no, CASE WHEN ends_with(file_path, '.py') THEN CASE WHEN regexp_extract(line, '^(?:from\s+(\S+)\s+import|import\s+(\S+))', 1) <> '' THEN regexp_extract(line, '^(?:from\s+(\S+)\s+import|import\s+(\S+))', 1) ELSE regexp_extract(line, '^import\s+([\w.]+)', 1) END
 WHEN regexp_extract(line, 'import\s+.*\s+from\s+[''"]([^''"]+)[''"]', 1) <> '' THEN regexp_extract(line, 'import\s+.*\s+from\s+[''"]([^''"]+)[''"]', 1) ELSE regexp_extract(line, '^\s*import\s+[''"]([^''"]+)[''"]', 1) END AS module FROM l),
imp AS (SELECT * FROM i WHERE module <> '')"""


@query("pl3_imports", f"WITH {IMPORTS} SELECT * FROM imp")
def imports(spark, d):
    return graph.imports(table(spark, d, "source_files"))


CANDIDATES = ", ".join([f"base || '{s}'" for s in graph.PLACES] + [f"'src/' || base || '{s}'" for s in graph.PLACES])


@query("j10_resolved_imports", rf"""
WITH {IMPORTS}, b AS (SELECT DISTINCT repo_id, module, replace(regexp_replace(module, '^(\.\./|\./)+', ''), '.', '/') AS base FROM imp),
c AS (SELECT repo_id, module, unnest([{CANDIDATES}]) AS candidate, generate_subscripts([{CANDIDATES}], 1) AS rank FROM b),
k AS (SELECT c.repo_id, c.module, arg_min(c.candidate, c.rank) AS resolved FROM c JOIN (SELECT DISTINCT repo_id, file_path FROM source_files) f ON f.repo_id = c.repo_id AND f.file_path = c.candidate GROUP BY 1, 2)
SELECT imp.repo_id, imp.module, imp.snapshot_id, imp.file_path, imp.line_no, k.resolved FROM imp LEFT JOIN k USING (repo_id, module)""")
def resolved_imports(spark, d):
    f = table(spark, d, "source_files")
    return graph.resolve_imports(graph.imports(f), f)


@query("g6_module_fan_in", f"WITH {IMPORTS} SELECT repo_id, module, count(DISTINCT file_path) AS importers FROM imp GROUP BY 1, 2")
def fan_in(spark, d):
    return graph.imports(table(spark, d, "source_files")).groupBy("repo_id", "module").agg(F.countDistinct("file_path").alias("importers"))


@query("ag22_out_degree", f"""
WITH {IMPORTS}, c AS (SELECT repo_id, file_path, count(DISTINCT module) AS n, array_to_string(list_sort(list(DISTINCT module))[:3], ', ') AS first_three FROM imp GROUP BY 1, 2)
SELECT repo_id, file_path, n, first_three, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, file_path) AS place FROM c) WHERE place <= 10""")
def out_degree(spark, d):
    c = graph.imports(table(spark, d, "source_files")).groupBy("repo_id", "file_path").agg(F.countDistinct("module").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("module")), 1, 3), ", ").alias("first_three"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("n"), "file_path"))).where("place <= 10")


@query("ag13_index_stats", """
SELECT repo_id, count(DISTINCT file_path) AS files, count(*) AS symbols, count(*) FILTER (symbol_type = 'class') AS classes, count(*) FILTER (symbol_type IN ('function', 'method')) AS functions FROM symbols GROUP BY 1""")
def stats(spark, d):
    s = table(spark, d, "symbols")
    return s.groupBy("repo_id").agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("symbol_type") == "class").alias("classes"), F.count_if(F.col("symbol_type").isin("function", "method")).alias("functions"))


@query("ag23_important_files", """
WITH c AS (SELECT repo_id, file_path, count(*) AS n FROM symbols GROUP BY 1, 2)
SELECT repo_id, file_path, n, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, file_path) AS place FROM c) WHERE place <= 20""")
def important(spark, d):
    c = table(spark, d, "symbols").groupBy("repo_id", "file_path").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("n"), "file_path"))).where("place <= 20")


@query("g2_symbol_lookup", """
SELECT symbol_id, repo_id, qualified_name, symbol_type FROM symbols WHERE contains(lower(symbol_name), 'webhook') AND symbol_type IN ('function', 'method')""")
def lookup(spark, d):
    """Case-insensitive partial look-up by name and type."""
    return table(spark, d, "symbols").where(F.lower("symbol_name").contains("webhook") & F.col("symbol_type").isin("function", "method")).select("symbol_id", "repo_id", "qualified_name", "symbol_type")


@query("j12_file_context", f"""
WITH {IMPORTS}, s AS (SELECT repo_id, file_path, count(*) AS symbols FROM symbols GROUP BY 1, 2), m AS (SELECT repo_id, file_path, count(*) AS imports FROM imp GROUP BY 1, 2)
SELECT coalesce(s.repo_id, m.repo_id) AS repo_id, coalesce(s.file_path, m.file_path) AS file_path, coalesce(symbols, 0) AS symbols, coalesce(imports, 0) AS imports FROM s FULL JOIN m ON s.repo_id = m.repo_id AND s.file_path = m.file_path""")
def file_context(spark, d):
    s = table(spark, d, "symbols").groupBy("repo_id", "file_path").agg(F.count(F.lit(1)).alias("symbols"))
    m = graph.imports(table(spark, d, "source_files")).groupBy("repo_id", "file_path").agg(F.count(F.lit(1)).alias("imports"))
    return s.join(m, ["repo_id", "file_path"], "full").select("repo_id", "file_path", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("imports", F.lit(0)).alias("imports"))


@query("j11_resolved_calls", f"""
WITH {EDGES}, n AS (SELECT DISTINCT c.repo_id, c.caller, c.n FROM cal c WHERE c.n <> c.self)
SELECT n.repo_id, n.caller, n.n AS callee_name, coalesce(d.callee, n.n) AS callee, d.callee IS NOT NULL AS is_resolved FROM n LEFT JOIN def d ON d.repo_id = n.repo_id AND d.symbol_name = n.n""")
def resolved_calls(spark, d):
    own = table(spark, d, "symbols").where(F.col("symbol_type").isin("function", "method"))
    defined = own.groupBy("repo_id", F.col("symbol_name").alias("callee_name")).agg(F.min("qualified_name").alias("callee"))
    n = own.select("repo_id", F.col("qualified_name").alias("caller"), "symbol_name", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(graph.CALL), F.lit(1)))).alias("callee_name")).where("callee_name <> symbol_name").select("repo_id", "caller", "callee_name").distinct()
    return n.join(defined, ["repo_id", "callee_name"], "left").select("repo_id", "caller", "callee_name", F.coalesce("callee", "callee_name").alias("callee"), F.col("callee").isNotNull().alias("is_resolved"))



RESOLVED = f"""{IMPORTS}, b AS (SELECT DISTINCT repo_id, module, replace(regexp_replace(module, '^(\\.\\./|\\./)+', ''), '.', '/') AS base FROM imp),
c AS (SELECT repo_id, module, unnest([{CANDIDATES}]) AS candidate, generate_subscripts([{CANDIDATES}], 1) AS rank FROM b),
k AS (SELECT c.repo_id, c.module, arg_min(c.candidate, c.rank) AS resolved FROM c JOIN (SELECT DISTINCT repo_id, file_path FROM source_files) f ON f.repo_id = c.repo_id AND f.file_path = c.candidate GROUP BY 1, 2)"""


@query("j13_symbol_context", f"""
WITH {EDGES}, {RESOLVED}, o AS (SELECT DISTINCT repo_id, file_path, qualified_name FROM symbols),
cr AS (SELECT repo_id, callee AS qualified_name, count(*) AS callers FROM edges GROUP BY 1, 2), ce AS (SELECT repo_id, caller AS qualified_name, count(*) AS callees FROM edges GROUP BY 1, 2),
fs AS (SELECT repo_id, file_path, count(*) AS file_symbols FROM o GROUP BY 1, 2), fi AS (SELECT repo_id, file_path, count(DISTINCT module) AS imports FROM imp GROUP BY 1, 2),
fb AS (SELECT imp.repo_id, k.resolved AS file_path, count(DISTINCT imp.file_path) AS imported_by FROM imp JOIN k USING (repo_id, module) GROUP BY 1, 2)
SELECT o.repo_id, o.file_path, o.qualified_name, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees, coalesce(file_symbols, 0) AS file_symbols, coalesce(imports, 0) AS imports, coalesce(imported_by, 0) AS imported_by
FROM o LEFT JOIN cr USING (repo_id, qualified_name) LEFT JOIN ce USING (repo_id, qualified_name) LEFT JOIN fs USING (repo_id, file_path) LEFT JOIN fi USING (repo_id, file_path) LEFT JOIN fb USING (repo_id, file_path)""")
def symbol_context(spark, d):
    """Every symbol with its callers, callees and what stands around its file."""
    f = table(spark, d, "source_files")
    imported = graph.imports(f)
    return graph.with_context(table(spark, d, "symbols"), edges(spark, d), imported, graph.resolve_imports(imported, f))
