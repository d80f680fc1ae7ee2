from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query, table

# fixed values: layers by words of paths, patterns by words of names, purposes of folders
LAYERS = [("Presentation", ["route", "controller", "view", "component", "page"]), ("Business Logic", ["service", "usecase", "business"]), ("Data Access", ["model", "repository", "database", "dao"]), ("Infrastructure", ["config", "middleware", "util", "helper"])]
PATTERNS = [("MVC Pattern (Controllers)", ["controller"]), ("Service Layer Pattern", ["service"]), ("Repository Pattern", ["repository"]), ("Factory Pattern", ["factory"]), ("Singleton Pattern", ["singleton"]), ("Handler/Command Pattern", ["handler"]), ("Middleware Pattern", ["middleware"]), ("Decorator Pattern", ["decorator", "wrapper"]), ("Rule Engine", ["rule"]), ("Snapshot", ["snapshot"])]
PURPOSES = {"src": "Source code", "app": "Application code", "lib": "Library/utilities", "api": "API routes/endpoints", "routes": "URL routes", "controllers": "Request controllers", "models": "Data models", "views": "View templates", "components": "UI components", "services": "Business logic services", "utils": "Utility functions", "helpers": "Helper functions", "tests": "Test files", "config": "Configuration", "database": "Database related", "migrations": "Database migrations", "middleware": "Middleware", "static": "Static assets", "public": "Public files", "assets": "Asset files"}


def chosen(col, table_):
    out = None
    for name, words in table_:
        test = F.lit(False)
        for w in words:
            test = test | col.contains(w)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def chosen_sql(expr, table_):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({expr}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in table_) + " END"


@query("d2_layers", f"""
WITH l AS (SELECT repo_id, {chosen_sql('lower(file_path)', LAYERS)} AS layer, symbol_name || ' (' || file_path || ')' AS entry, symbol_id FROM symbols)
SELECT repo_id, layer, entry, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, layer ORDER BY symbol_id) AS place FROM l WHERE layer IS NOT NULL) WHERE place <= 5""")
def layers(spark, d):
    """The first five symbols of each layer: a listing with a stated length."""
    l = table(spark, d, "symbols").select("repo_id", chosen(F.lower("file_path"), LAYERS).alias("layer"), F.concat("symbol_name", F.lit(" ("), "file_path", F.lit(")")).alias("entry"), "symbol_id").where("layer IS NOT NULL")
    return l.withColumn("place", F.row_number().over(Window.partitionBy("repo_id", "layer").orderBy("symbol_id"))).where("place <= 5").select("repo_id", "layer", "entry", "place")


@query("d3_symbol_map", """
SELECT repo_id, symbol_type, count(*) AS symbols, count(DISTINCT file_path) AS files, count(docstring) AS documented FROM symbols GROUP BY 1, 2""")
def symbol_map(spark, d):
    return table(spark, d, "symbols").groupBy("repo_id", "symbol_type").agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("file_path").alias("files"), F.count("docstring").alias("documented"))


TAGS = " UNION ALL ".join(f"SELECT repo_id, '{n}' AS tag FROM symbols WHERE " + " OR ".join(f"contains(lower(symbol_name), '{w}')" for w in words) for n, words in PATTERNS)


@query("d4_pattern_tags", f"SELECT repo_id, string_agg(DISTINCT tag, ', ' ORDER BY tag) AS tags FROM ({TAGS}) GROUP BY 1")
def tags(spark, d):
    low = F.lower("symbol_name")
    found = F.array_compact(F.array(*[F.when(F.lit(False) | low.contains(words[0]) | (low.contains(words[-1])), F.lit(n)) for n, words in PATTERNS]))
    return table(spark, d, "symbols").select("repo_id", F.explode(found).alias("tag")).groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("tags"))


ENDS = [("Factory Pattern", "factory"), ("Builder Pattern", "builder"), ("Observer Pattern", "observer"), ("Observer Pattern", "listener"), ("Strategy Pattern", "strategy"), ("Rule Object", "rule"), ("Snapshot", "snapshot")]


@query("d5_design_patterns", "SELECT symbol_id, CASE " + " ".join(f"WHEN ends_with(lower(symbol_name), '{w}') THEN '{n}'" for n, w in ENDS) + " END AS pattern FROM symbols WHERE symbol_type = 'class' AND (" + " OR ".join(f"ends_with(lower(symbol_name), '{w}')" for _, w in ENDS) + ")")
def design(spark, d):
    low, out = F.lower("symbol_name"), None
    for n, w in ENDS:
        out = F.when(low.endswith(w), n) if out is None else out.when(low.endswith(w), n)
    return table(spark, d, "symbols").where("symbol_type = 'class'").select("symbol_id", out.alias("pattern")).where("pattern IS NOT NULL")


@query("d6_key_directories", "SELECT DISTINCT repo_id, string_split(file_path, '/')[1] AS folder, CASE lower(string_split(file_path, '/')[1]) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PURPOSES.items()) + " ELSE 'Project files' END AS purpose FROM symbols WHERE contains(file_path, '/')")
def directories(spark, d):
    names = F.create_map(*[F.lit(x) for kv in PURPOSES.items() for x in kv])
    top = F.get(F.split("file_path", "/"), F.lit(0))
    return table(spark, d, "symbols").where(F.col("file_path").contains("/")).select("repo_id", top.alias("folder")).distinct().withColumn("purpose", F.coalesce(F.try_element_at(names, F.lower("folder")), F.lit("Project files")))


@query("ag24_folder_rollup", """
SELECT string_split(file_path, '/')[1] AS a, string_split(file_path, '/')[2] AS b, count(*) AS symbols, grouping(string_split(file_path, '/')[1])::INTEGER AS all_a, grouping(string_split(file_path, '/')[2])::INTEGER AS all_b
FROM symbols GROUP BY ROLLUP (string_split(file_path, '/')[1], string_split(file_path, '/')[2])""")
def folders(spark, d):
    p = F.split("file_path", "/")
    s = table(spark, d, "symbols").select(F.get(p, F.lit(0)).alias("a"), F.get(p, F.lit(1)).alias("b"))
    return s.rollup("a", "b").agg(F.count(F.lit(1)).alias("symbols"), F.grouping("a").cast("int").alias("all_a"), F.grouping("b").cast("int").alias("all_b"))


@query("d1_overview", """
SELECT r.full_name, count(DISTINCT s.file_path) AS files, count(*) FILTER (symbol_type = 'class') AS classes, count(*) FILTER (symbol_type <> 'class') AS functions, round(avg(length(body)), 4) AS mean_body FROM symbols s JOIN repositories r USING (repo_id) GROUP BY 1""")
def overview(spark, d):
    s = table(spark, d, "symbols").join(table(spark, d, "repositories").select("repo_id", "full_name"), "repo_id")
    return s.groupBy("full_name").agg(F.countDistinct("file_path").alias("files"), F.count_if(F.col("symbol_type") == "class").alias("classes"), F.count_if(F.col("symbol_type") != "class").alias("functions"), F.round(F.avg(F.length("body")), 4).alias("mean_body"))


@query("w8_first_symbols", """
SELECT snapshot_id, qualified_name, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY line_start, symbol_id) AS place FROM symbols WHERE line_start IS NOT NULL) WHERE place <= 10""")
def first_symbols(spark, d):
    s = table(spark, d, "symbols").where("line_start IS NOT NULL")
    return s.withColumn("place", F.row_number().over(Window.partitionBy("snapshot_id").orderBy("line_start", "symbol_id"))).where("place <= 10").select("snapshot_id", "qualified_name", "place")


@query("d1_overview_text", """
WITH c AS (SELECT repo_id, count(DISTINCT file_path) AS files, count(*) FILTER (symbol_type = 'class') AS classes, count(*) FILTER (symbol_type IN ('function', 'method')) AS functions FROM symbols GROUP BY 1),
t AS (SELECT repo_id, file_path, row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, file_path) AS place FROM symbols WHERE file_path IS NOT NULL GROUP BY 1, 2),
l AS (SELECT repo_id, string_agg('- `' || file_path || '`', chr(10) ORDER BY place) AS listed FROM t WHERE place <= 5 GROUP BY 1)
SELECT r.repo_id, '# ' || full_name || chr(10) || chr(10) || 'Files: ' || coalesce(files, 0) || ', classes: ' || coalesce(classes, 0) || ', functions: ' || coalesce(functions, 0) || chr(10) || chr(10) || '## Key files' || chr(10) || coalesce(listed, 'none') AS body FROM repositories r LEFT JOIN c USING (repo_id) LEFT JOIN l USING (repo_id)""")
def overview_text(spark, d):
    """The overview of each repository as a document: its counts and the five files with the most symbols."""
    s = table(spark, d, "symbols")
    c = s.groupBy("repo_id").agg(F.countDistinct("file_path").alias("files"), F.count_if(F.col("symbol_type") == "class").alias("classes"), F.count_if(F.col("symbol_type").isin("function", "method")).alias("functions"))
    t = s.where("file_path IS NOT NULL").groupBy("repo_id", "file_path").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("n"), "file_path"))).where("place <= 5")
    listed = t.groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "file_path"))), lambda x: F.concat(F.lit("- `"), x["file_path"], F.lit("`"))), "\n").alias("listed"))
    n = lambda k: F.coalesce(k, F.lit(0)).cast("string")
    body = F.concat(F.lit("# "), "full_name", F.lit("\n\nFiles: "), n("files"), F.lit(", classes: "), n("classes"), F.lit(", functions: "), n("functions"), F.lit("\n\n## Key files\n"), F.coalesce("listed", F.lit("none")))
    return table(spark, d, "repositories").select("repo_id", "full_name").join(c, "repo_id", "left").join(listed, "repo_id", "left").select("repo_id", body.alias("body"))
