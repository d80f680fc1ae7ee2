from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, parsing
from .graph import IMPORTS
from .registry import query, quoted, table


def lines(pattern: str) -> str:
    return f"l AS (SELECT snapshot_id, file_path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INTEGER AS line_no FROM source_files WHERE regexp_matches(file_path, '{pattern}'))"


DEF = r"'^\s*def\s+(\w+)\s*\(([^)]*)\)'"


@query("pl5_python_outline", rf"""
WITH {lines(r'\.py$')}, h AS (SELECT snapshot_id, file_path, line_no, regexp_extract(line, '^class\s+(\w+)', 1) AS cls, regexp_extract(line, {DEF}, 1) AS fn, regexp_extract(line, {DEF}, 2) AS params, regexp_extract(line, '^(\s*)def\s+\w+\s*\([^)]*\)', 1) AS lead FROM l),
s AS (SELECT *, coalesce(last_value(CASE WHEN cls <> '' THEN cls WHEN lead = '' THEN '' END IGNORE NULLS) OVER (PARTITION BY snapshot_id ORDER BY line_no), '') AS scope FROM h WHERE cls <> '' OR fn <> ''),
n AS (SELECT *, CASE WHEN cls <> '' THEN cls ELSE fn END AS name, cls = '' AND lead <> '' AND scope <> '' AS inside FROM s)
SELECT snapshot_id, file_path, line_no, CASE WHEN cls <> '' THEN 'class' WHEN inside THEN 'method' ELSE 'function' END AS kind, name, CASE WHEN inside THEN scope || '.' || name ELSE name END AS qualified, CASE WHEN cls = '' THEN 'def ' || name || '(' || params || ')' END AS signature, CASE WHEN starts_with(name, '_') THEN 'private' ELSE 'public' END AS visibility FROM n""")
def python_outline(spark, d):
    return parsing.python_outline(table(spark, d, "source_files"))


JS = r"'(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\()'"


@query("pl8_script_outline", rf"""
WITH {lines(r'\.(js|ts|jsx|tsx)$')}
SELECT snapshot_id, file_path, line_no, 'class' AS kind, regexp_extract(line, 'class\s+(\w+)', 1) AS name FROM l WHERE regexp_matches(line, 'class\s+(\w+)')
UNION ALL SELECT snapshot_id, file_path, line_no, 'function', regexp_extract(line, {JS}, 1) || regexp_extract(line, {JS}, 2) FROM l WHERE regexp_matches(line, {JS})""")
def script_outline(spark, d):
    return parsing.script_outline(table(spark, d, "source_files"))


@query("pl9_plain_outline", rf"""
WITH {lines(r'\.(php|rb|go|java|rs|c|cpp|cs)$')}
SELECT snapshot_id, file_path, line_no, 'class' AS kind, regexp_extract(line, 'class\s+(\w+)', 1) AS name FROM l WHERE regexp_matches(line, 'class\s+(\w+)')
UNION ALL SELECT snapshot_id, file_path, line_no, 'function', regexp_extract(line, '(?:function|def|func|fn)\s+(\w+)', 1) FROM l WHERE regexp_matches(line, '(?:function|def|func|fn)\s+(\w+)')""")
def plain_outline(spark, d):
    return parsing.plain_outline(table(spark, d, "source_files"))


@query("pl13_added_lines", """
WITH t AS (SELECT snapshot_id AS patch_id, string_split(content, chr(10)) AS ls, 1 + snapshot_id % 50 AS s FROM source_files),
l AS (SELECT patch_id, s, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM t),
k AS (SELECT *, CASE n % 3 WHEN 0 THEN ' ' WHEN 1 THEN '+' ELSE '-' END AS mark, n > 10 AS second FROM l),
c AS (SELECT *, sum(CASE WHEN mark = '-' THEN 0 ELSE 1 END) OVER (PARTITION BY patch_id, second ORDER BY n) AS moved FROM k)
SELECT patch_id, (s + (CASE WHEN second THEN 500 ELSE 0 END) + moved - 1)::INTEGER AS line_no FROM c WHERE mark = '+' AND NOT starts_with(line, '++')""")
def added_lines(spark, d):
    """Each file as a patch of two hunks, whose lines are added, removed and left in turn."""
    f = table(spark, d, "source_files")
    mark = lambda i: F.when((i + 1) % 3 == 0, " ").when((i + 1) % 3 == 1, "+").otherwise("-")
    marked = F.transform(F.split("content", "\n", -1), lambda x, i: F.concat(mark(i), x))
    start = 1 + F.col("snapshot_id") % 50
    head = lambda n: F.array(F.concat(F.lit("@@ -7,9 +"), n.cast("string"), F.lit(",9 @@ def f():")))
    f = f.select("snapshot_id", start.alias("s"), marked.alias("m"))
    hunks = F.concat(head(F.col("s")), F.slice("m", 1, 10), F.when(F.size("m") > 10, F.concat(head(F.col("s") + 500), F.slice("m", 11, F.greatest(F.size("m") - 10, F.lit(1))))).otherwise(F.array().cast("array<string>")))
    return parsing.added_lines(f.select(F.col("snapshot_id").alias("patch_id"), F.array_join(hunks, "\n").alias("patch")))


@query("pl1_python_symbols")
def python_symbols(spark, d):
    return parsing.python_symbols(table(spark, d, "source_files"))


@query("pl4_calls")
def calls(spark, d):
    """Calls of Python files from their syntax trees; without SQL, which does not parse; tested on small files."""
    return parsing.python_calls(table(spark, d, "source_files"))


@query("pl10_repository_symbols")
def repository_symbols(spark, d):
    """Functions of all languages with a grammar, and the first error of each file that does not parse; without SQL, which does not parse."""
    return parsing.repository_symbols(table(spark, d, "source_files"))


@query("pl11_short_names")
def short_names(spark, d):
    """Python symbols under bare names; files that do not parse by their lines; without SQL, which does not parse."""
    return parsing.python_outline_short(table(spark, d, "source_files"))


CASES = " ".join(f"WHEN contains(lower(file_path), '{s}') THEN {k}" for k, (_, s) in enumerate(parsing.FRAMEWORKS))
NAMES = "[" + ", ".join(f"'{n}'" for n, _ in parsing.FRAMEWORKS) + "]"


BY_IMPORT = " ".join(f"WHEN contains(lower(module), '{s}') THEN {k}" for k, (_, s) in enumerate(parsing.IMPORTED))
IMPORTED = "[" + ", ".join(f"'{n}'" for n, _ in parsing.IMPORTED) + "]"


@query("pl14_frameworks", f"WITH {IMPORTS}, b AS (SELECT repo_id, min(CASE {CASES} END) AS k FROM source_files GROUP BY 1), i2 AS (SELECT repo_id, min(CASE {BY_IMPORT} END) AS i FROM imp GROUP BY 1) SELECT b.repo_id, coalesce(({NAMES})[k + 1], ({IMPORTED})[i + 1], 'unknown') AS framework FROM b LEFT JOIN i2 USING (repo_id)")
def frameworks(spark, d):
    """By paths, else by imported modules."""
    f = table(spark, d, "source_files")
    return parsing.frameworks(f, graph.imports(f))


@query("pl15_chunks", """
SELECT symbol_id, concat_ws(chr(10), 'Symbol: ' || symbol_name, signature, docstring, body) AS chunk, length(concat_ws(chr(10), 'Symbol: ' || symbol_name, signature, docstring, body)) // 4 AS rough_tokens
FROM symbols WHERE body <> '' OR docstring <> ''""")
def chunks(spark, d):
    """Text of a symbol for an index: its parts that are there, one below the other."""
    text = F.concat_ws("\n", F.concat(F.lit("Symbol: "), "symbol_name"), "signature", "docstring", "body")
    return table(spark, d, "symbols").where("body <> '' OR docstring <> ''").select("symbol_id", text.alias("chunk"), F.floor(F.length(text) / 4).alias("rough_tokens"))


@query("pl17_search_text", "SELECT symbol_id, concat_ws(' ', symbol_name, signature, docstring) AS search_text FROM symbols")
def search_text(spark, d):
    return table(spark, d, "symbols").select("symbol_id", F.concat_ws(" ", "symbol_name", "signature", "docstring").alias("search_text"))


#: Three ways to declare routes, by the remainder of a file's number; the tables hold no route files.
SHAPES = [
    ("Route::prefix('api')->middleware('auth')->group(function () { Route::group(['prefix' => 'v1'], function () { Route::apiResource('items', ItemController::class); }); });",
     [("GET", "/api/v1/items", "ItemController", "index", "auth"), ("POST", "/api/v1/items", "ItemController", "store", "auth"), ("GET", "/api/v1/items/{id}", "ItemController", "show", "auth"), ("PUT", "/api/v1/items/{id}", "ItemController", "update", "auth"), ("DELETE", "/api/v1/items/{id}", "ItemController", "destroy", "auth")]),
    ("Route::get('users/{id}', [UserController::class, 'show'])->middleware(['auth', 'verified']); Route::post('login', 'LoginController@store');",
     [("GET", "/users/{id}", "UserController", "show", "auth,verified"), ("POST", "/login", "LoginController", "store", "")]),
    ("Route::controller(OrderController::class)->prefix('shop')->group(function () { Route::match(['get', 'post'], 'orders', 'index'); Route::delete('orders/{id}', 'destroy'); });",
     [("GET", "/shop/orders", "OrderController", "index", ""), ("POST", "/shop/orders", "OrderController", "index", ""), ("DELETE", "/shop/orders/{id}", "OrderController", "destroy", "")]),
]
DECLARED = ", ".join("(" + str(k) + ", " + quoted(row) + ")" for k, (_, found) in enumerate(SHAPES) for row in found)


@query("pl16_routes", f"""
SELECT snapshot_id, method, uri, controller, action, middleware FROM source_files JOIN (VALUES {DECLARED}) v(shape, method, uri, controller, action, middleware) ON snapshot_id % 3 = shape WHERE ends_with(file_path, '.php')""")
def routes(spark, d):
    """Each PHP file declares routes in one of three ways behind its own text."""
    from ..operators.routes import routes as found

    tail = F.when(F.col("snapshot_id") % 3 == 0, SHAPES[0][0]).when(F.col("snapshot_id") % 3 == 1, SHAPES[1][0]).otherwise(SHAPES[2][0])
    f = table(spark, d, "source_files").where(F.col("file_path").endswith(".php")).withColumn("content", F.concat("content", F.lit("\n"), tail))
    return found(f).select("snapshot_id", "method", "uri", "controller", "action", F.array_join("middleware", ",").alias("middleware"))


@query("sc15_context_json", """
SELECT repo_id, to_json({classes: count(*) FILTER (symbol_type = 'class'), files: count(DISTINCT file_path), symbols: count(*)})::VARCHAR AS json FROM symbols GROUP BY 1""")
def context_json(spark, d):
    from ..sources.files import context_json as record

    s = table(spark, d, "symbols").groupBy("repo_id").agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("file_path").alias("files"), F.count_if(F.col("symbol_type") == "class").alias("classes"))
    return record(s, "repo_id")
