"""Symbol, dependency and call graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

# fixed values: words of names that look like entry points, and routes by their decorators
ENTRY_WORDS = ["main", "__main__", "app", "server", "index", "handle", "handler", "route", "endpoint", "view", "cli", "command", "run", "start", "init"]
ROUTE_MARKS = ["@app.", "@router.", "@route", "@get", "@post", "@put", "@delete"]
CALL = r"\b([A-Za-z_]\w*)\s*\("


def call_edges(symbols: DataFrame) -> DataFrame:
    """Calls inside the bodies of functions that name a function of the same repository.

    Names are made distinct in a body before the shuffle; a name defined several times in a
    repository resolves to its smallest qualified name, so an edge stays one row.
    """
    own = symbols.where(F.col("symbol_type").isin("function", "method"))
    defined = own.groupBy("repo_id", F.col("symbol_name").alias("callee_name")).agg(F.min("qualified_name").alias("callee"))
    called = own.select("repo_id", F.col("qualified_name").alias("caller"), F.col("symbol_name"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(CALL), F.lit(1)))).alias("callee_name")).where("callee_name <> symbol_name")
    return called.join(defined, ["repo_id", "callee_name"]).select("repo_id", "caller", "callee").distinct()


def imports(files: DataFrame) -> DataFrame:
    """Imported modules of Python and JavaScript files with their lines."""
    f = files.where(F.col("file_path").rlike(r"\.(py|js|ts)$")).select("snapshot_id", "repo_id", "file_path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"))
    py = F.regexp_extract("line", r"^(?:from\s+(\S+)\s+import|import\s+(\S+))", 1)
    py2 = F.regexp_extract("line", r"^import\s+([\w.]+)", 1)
    js = F.regexp_extract("line", r"import\s+.*\s+from\s+['\"]([^'\"]+)['\"]", 1)
    bare = F.regexp_extract("line", r"^\s*import\s+['\"]([^'\"]+)['\"]", 1)  # for its effects only
    module = F.when(F.col("file_path").endswith(".py"), F.when(py != "", py).otherwise(py2)).when(js != "", js).otherwise(bare)
    return f.select("snapshot_id", "repo_id", "file_path", (F.col("pos") + 1).alias("line_no"), module.alias("module")).where("module <> ''")


# fixed values: where a module may lie, in the order in which places are tried
PLACES = [".py", "/__init__.py", ".js", ".ts", ".tsx", "/index.js", "/index.ts", "/index.tsx"]


def resolve_imports(imported: DataFrame, files: DataFrame) -> DataFrame:
    """The first known file among the candidates of each module, beside it and under src/; null for outside modules."""
    base = F.replace(F.regexp_replace("module", r"^(\.\./|\./)+", ""), F.lit("."), F.lit("/"))
    candidates = F.array(*[F.concat(base, F.lit(s)) for s in PLACES], *[F.concat(F.lit("src/"), base, F.lit(s)) for s in PLACES])
    c = imported.select("repo_id", "module").distinct().select("repo_id", "module", F.posexplode(candidates).alias("rank", "candidate"))
    known = files.select("repo_id", F.col("file_path").alias("candidate")).distinct()
    best = c.join(known, ["repo_id", "candidate"]).groupBy("repo_id", "module").agg(F.min_by("candidate", "rank").alias("resolved"))
    return imported.join(best, ["repo_id", "module"], "left")


def entry_points(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions with an entry word in their name that nobody calls, and functions with a route mark in their body."""
    own = symbols.where(F.col("symbol_type").isin("function", "method"))
    low, body = F.lower("symbol_name"), F.lower(F.coalesce("body", F.lit("")))
    named = F.lit(False)
    for w in ENTRY_WORDS:
        named = named | low.contains(w)
    marked = F.lit(False)
    for m in ROUTE_MARKS:
        marked = marked | body.contains(m)
    called = edges.select(F.col("callee").alias("qualified_name"), "repo_id").distinct().withColumn("called", F.lit(True))
    j = own.select("repo_id", "qualified_name", "symbol_name", named.alias("named"), marked.alias("marked")).join(called, ["repo_id", "qualified_name"], "left")
    return j.where(F.col("marked") | F.col("named") & (F.col("called").isNull() | F.col("symbol_name").isin("main", "__main__", "app"))).select("repo_id", "qualified_name").distinct()


def traces(edges: DataFrame, starts: DataFrame, depth: int = 5, branches: int = 10) -> DataFrame:
    """Simple paths of at most `depth` edges from the starts to symbols that call nothing more.

    A symbol is followed to the first `branches` of its callees in alphabetical order, so the open paths stay
    bounded where a hub calls everything. The edges are written once for all levels; each level joins the open
    paths to them, and a path ends where no edge leaves.
    """
    place = F.row_number().over(Window.partitionBy("repo_id", "at").orderBy("callee"))
    e = kept(edges.select("repo_id", F.col("caller").alias("at"), "callee").distinct().withColumn("place", place).where(F.col("place") <= branches).drop("place"))
    leaves = kept(e.select("repo_id", F.col("callee").alias("at")).distinct().join(e.select("repo_id", "at").distinct(), ["repo_id", "at"], "left_anti"))
    paths, out = starts.select("repo_id", F.array("qualified_name").alias("path")), None
    for _ in range(depth):
        step = paths.withColumn("at", F.element_at("path", -1)).join(e, ["repo_id", "at"]).where(~F.array_contains("path", F.col("callee")))
        paths = step.select("repo_id", F.array_append("path", F.col("callee")).alias("path"))
        done = paths.withColumn("at", F.element_at("path", -1)).join(leaves, ["repo_id", "at"]).select("repo_id", "path")
        out = done if out is None else out.unionAll(done)
    return out


def callers_of(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(repo_id, wanted) -> callers of the symbol of that name; where nobody calls it, of every symbol whose name holds it.

    The fallback goes through runs of up to eight characters: a callee that holds a name holds the name's first
    eight, or the whole of a shorter one, so only pairs that share such a run meet. Of each callee those runs are
    made whose length the names of its repository have. They are many more than the callees, which the optimizer
    does not foresee, so their join is told to sort instead of sending them to every task. Empty names find nothing.
    """
    exact = wanted.join(edges.select("repo_id", F.col("callee").alias("wanted"), "caller"), ["repo_id", "wanted"]).withColumn("is_exact", F.lit(True))
    rest = wanted.join(edges.select("repo_id", F.col("callee").alias("wanted")).distinct(), ["repo_id", "wanted"], "left_anti").where("wanted <> ''")
    probes = rest.withColumn("run", F.left("wanted", F.lit(8)))
    lengths = probes.groupBy("repo_id").agg(F.collect_set(F.length("run")).alias("lengths"))
    fit = F.filter("lengths", lambda n: n <= F.length("callee"))
    runs = F.array_distinct(F.flatten(F.transform(fit, lambda n: F.transform(F.sequence(F.lit(1), F.length("callee") - n + 1), lambda k: F.substring("callee", k, n)))))
    called = edges.select("repo_id", "callee").distinct().where("callee <> ''")
    held = called.join(lengths, "repo_id").select("repo_id", "callee", F.explode(runs).alias("run")).hint("merge")
    pairs = probes.join(held, ["repo_id", "run"]).where(F.col("callee").contains(F.col("wanted"))).select("repo_id", "wanted", "callee")
    partial = pairs.join(edges, ["repo_id", "callee"]).select("repo_id", "wanted", "caller").distinct().withColumn("is_exact", F.lit(False))
    return exact.unionByName(partial)


def importers(resolved: DataFrame) -> DataFrame:
    """Number of different files that import each known file."""
    known = resolved.where("resolved IS NOT NULL").select("repo_id", F.col("resolved").alias("file_path"), F.col("file_path").alias("by")).distinct()
    return known.groupBy("repo_id", "file_path").agg(F.count(F.lit(1)).alias("imported_by"))


def with_context(symbols: DataFrame, edges: DataFrame, imported: DataFrame, resolved: DataFrame) -> DataFrame:
    """Each symbol with the numbers of its callers and callees, and of its file's symbols, imports and importers. Counts are aggregated before the joins."""
    one = symbols.select("repo_id", "file_path", "qualified_name").distinct()
    callers = edges.groupBy("repo_id", F.col("callee").alias("qualified_name")).agg(F.count(F.lit(1)).alias("callers"))
    callees = edges.groupBy("repo_id", F.col("caller").alias("qualified_name")).agg(F.count(F.lit(1)).alias("callees"))
    beside = one.groupBy("repo_id", "file_path").agg(F.count(F.lit(1)).alias("file_symbols"))
    imports = imported.groupBy("repo_id", "file_path").agg(F.countDistinct("module").alias("imports"))
    out = one.join(callers, ["repo_id", "qualified_name"], "left").join(callees, ["repo_id", "qualified_name"], "left")
    for side in (beside, imports, importers(resolved)):
        out = out.join(side, ["repo_id", "file_path"], "left")
    counts = ("callers", "callees", "file_symbols", "imports", "imported_by")
    return out.select("repo_id", "file_path", "qualified_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def top_symbols(symbols: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """Per repository, half of the list classes by number of children, half functions by number of callers."""
    half = limit // 2
    callers = edges.groupBy("repo_id", F.col("callee").alias("qualified_name")).agg(F.count(F.lit(1)).alias("weight"))
    classes = symbols.where("symbol_type = 'class' AND parent IS NULL").select("repo_id", "qualified_name", F.coalesce(F.size("children"), F.lit(0)).cast("long").alias("weight"), F.lit("class").alias("kind"))
    functions = symbols.where("symbol_type = 'function' AND parent IS NULL").select("repo_id", "qualified_name", F.lit("function").alias("kind")).join(callers, ["repo_id", "qualified_name"], "left").select("repo_id", "qualified_name", F.coalesce("weight", F.lit(0)).alias("weight"), "kind")
    both = classes.unionByName(functions).groupBy("repo_id", "qualified_name", "kind").agg(F.max("weight").alias("weight"))
    place = F.row_number().over(Window.partitionBy("repo_id", "kind").orderBy(F.desc("weight"), "qualified_name"))
    return both.withColumn("place", place).where(F.col("place") <= half)
