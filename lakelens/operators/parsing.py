"""Symbols and added lines from text, by expressions alone; a syntax tree only for Python."""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import grammar


def numbered(files: DataFrame, pattern: str) -> DataFrame:
    return files.where(F.col("file_path").rlike(pattern)).select("snapshot_id", "file_path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"))


def python_outline(files: DataFrame) -> DataFrame:
    """Classes, functions and methods of Python files from their lines; an unindented function closes the class."""
    n = numbered(files, r"\.py$")
    cls, fn = F.regexp_extract("line", r"^class\s+(\w+)", 1), F.regexp_extract("line", r"^\s*def\s+(\w+)\s*\(([^)]*)\)", 1)
    params, lead = F.regexp_extract("line", r"^\s*def\s+(\w+)\s*\(([^)]*)\)", 2), F.regexp_extract("line", r"^(\s*)def\s+\w+\s*\([^)]*\)", 1)
    hit = n.where((cls != "") | (fn != "")).select("snapshot_id", "file_path", (F.col("pos") + 1).alias("line_no"), cls.alias("cls"), fn.alias("fn"), params.alias("params"), lead.alias("lead"))
    # a class opens a scope, an unindented function closes it with an empty name
    scope = F.last(F.when(F.col("cls") != "", F.col("cls")).when(F.col("lead") == "", F.lit("")), ignorenulls=True).over(Window.partitionBy("snapshot_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    s = hit.withColumn("scope", F.coalesce(scope, F.lit("")))
    inside = (F.col("cls") == "") & (F.col("lead") != "") & (F.col("scope") != "")
    name = F.when(F.col("cls") != "", F.col("cls")).otherwise(F.col("fn"))
    return s.select("snapshot_id", "file_path", "line_no", F.when(F.col("cls") != "", "class").when(inside, "method").otherwise("function").alias("kind"), name.alias("name"), F.when(inside, F.concat("scope", F.lit("."), name)).otherwise(name).alias("qualified"), F.when(F.col("cls") == "", F.concat(F.lit("def "), name, F.lit("("), "params", F.lit(")"))).alias("signature"), F.when(name.startswith("_"), "private").otherwise("public").alias("visibility"))


def script_outline(files: DataFrame) -> DataFrame:
    """Classes and functions of JavaScript and TypeScript files from their lines."""
    n = numbered(files, r"\.(js|ts|jsx|tsx)$")
    cls = F.regexp_extract("line", r"class\s+(\w+)", 1)
    fn = F.regexp_extract("line", r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\()", 1)
    fn2 = F.regexp_extract("line", r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\()", 2)
    found = F.array_compact(F.array(F.when(cls != "", F.struct(F.lit("class").alias("kind"), cls.alias("name"))), F.when((fn != "") | (fn2 != ""), F.struct(F.lit("function").alias("kind"), F.when(fn != "", fn).otherwise(fn2).alias("name")))))
    return n.select("snapshot_id", "file_path", (F.col("pos") + 1).alias("line_no"), F.explode(found).alias("f")).select("snapshot_id", "file_path", "line_no", "f.kind", "f.name")


def plain_outline(files: DataFrame) -> DataFrame:
    """Class and function words of other languages."""
    n = numbered(files, r"\.(php|rb|go|java|rs|c|cpp|cs)$")
    cls, fn = F.regexp_extract("line", r"class\s+(\w+)", 1), F.regexp_extract("line", r"(?:function|def|func|fn)\s+(\w+)", 1)
    found = F.array_compact(F.array(F.when(cls != "", F.struct(F.lit("class").alias("kind"), cls.alias("name"))), F.when(fn != "", F.struct(F.lit("function").alias("kind"), fn.alias("name")))))
    return n.select("snapshot_id", "file_path", (F.col("pos") + 1).alias("line_no"), F.explode(found).alias("f")).select("snapshot_id", "file_path", "line_no", "f.kind", "f.name")


def added_lines(patches: DataFrame) -> DataFrame:
    """patches(patch_id, patch) -> patch_id, line_no of each added line: a running count that starts anew at every hunk head."""
    n = patches.select("patch_id", F.posexplode(F.split("patch", "\n", -1)).alias("pos", "line"))
    order = Window.partitionBy("patch_id").orderBy("pos")
    head = F.col("line").startswith("@@")
    start = F.regexp_extract("line", r"\+(\d+)", 1)
    h = n.withColumn("hunk", F.sum((head & (start != "")).cast("int")).over(order)).withColumn("first", F.when(head & (start != ""), start.cast("int")))
    added = ~head & F.col("line").startswith("+") & ~F.col("line").startswith("+++")
    moves = added | ~head & ~F.col("line").startswith("-") & ~F.col("line").startswith("+") | ~head & F.col("line").startswith("+++")
    inside = Window.partitionBy("patch_id", "hunk").orderBy("pos")
    line = F.coalesce(F.max("first").over(inside), F.lit(1)) - 1 + F.sum(moves.cast("int")).over(inside)
    return h.select("patch_id", added.alias("added"), line.cast("int").alias("line_no")).where("added").select("patch_id", "line_no")


PY_SYMBOLS = "snapshot_id long, file_path string, kind string, name string, qualified string, line_start int, line_end int, docstring string, error string"
CALLS = "snapshot_id long, repo_id string, file_path string, line_no int, caller string, callee string"
SYMBOLS = "snapshot_id long, repo_id string, file_path string, kind string, name string, qualified string, line_start int, line_end int, signature string, error string"
SHORT = "snapshot_id long, file_path string, kind string, name string, line_start int, line_end int, signature string, docstring string, parent string, children array<string>, is_fallback boolean"
BROKEN = (SyntaxError, ValueError, RecursionError, MemoryError)


def each(files: DataFrame, one: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """one(*columns) -> rows for every row, in Arrow batches."""
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for cells in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in one(*cells)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out)], schema=out)

    return files.mapInArrow(run, schema)


def tree(content: str | None) -> ast.Module:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse((content or "").lstrip("\ufeff"))


def python_symbols(files: DataFrame) -> DataFrame:
    """Symbols of Python files from the syntax tree; a file that does not parse gives one row with its error."""

    def walk(node, path, owner, inside):
        for c in ast.iter_child_nodes(node):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(c, ast.ClassDef) else "method" if inside else "function"
                full = f"{owner}.{c.name}" if owner else c.name
                yield kind, c.name, f"{path}:{full}", c.lineno, c.end_lineno, ast.get_docstring(c)
                yield from walk(c, path, full, isinstance(c, ast.ClassDef))
            else:
                yield from walk(c, path, owner, inside)

    def one(sid, path, content):
        try:
            return [(sid, path, *x, None) for x in walk(tree(content), path, "", False)]
        except BROKEN as e:
            return [(sid, path, None, None, None, None, None, None, type(e).__name__)]

    return each(files.where(F.col("file_path").endswith(".py")).select("snapshot_id", "file_path", "content"), one, PY_SYMBOLS)


def python_calls(files: DataFrame) -> DataFrame:
    """Calls in Python files with the function they stand in.

    The caller is `path:name` of the innermost function, `path:Class.name` of a method, `path:module` elsewhere;
    the callee is the called expression as it is written. Of a class only methods without decorators count, of a
    function only its body; decorators belong to what stands around. Files that do not parse give no rows.
    """
    function = (ast.FunctionDef, ast.AsyncFunctionDef)

    def walk(node, path, caller, text):
        if isinstance(node, function):
            for d in node.decorator_list:
                yield from walk(d, path, caller, text)
            for s in node.body:
                yield from walk(s, path, f"{path}:{node.name}", text)
        elif isinstance(node, ast.ClassDef):
            for d in node.decorator_list:
                yield from walk(d, path, caller, text)
            for m in node.body:
                if isinstance(m, function) and not m.decorator_list:
                    for s in m.body:
                        yield from walk(s, path, f"{path}:{node.name}.{m.name}", text)
        else:
            if isinstance(node, ast.Call):
                yield node.lineno, caller, ast.get_source_segment(text, node.func)
            for c in ast.iter_child_nodes(node):
                yield from walk(c, path, caller, text)

    def one(sid, repo, path, content):
        text = (content or "").lstrip("\ufeff")
        try:
            return [(sid, repo, path, *x) for x in walk(tree(text), path, f"{path}:module", text)]
        except BROKEN:
            return []

    return each(files.where(F.col("file_path").endswith(".py")).select("snapshot_id", "repo_id", "file_path", "content"), one, CALLS)


def repository_symbols(files: DataFrame) -> DataFrame:
    """Functions and methods of all files whose language has a grammar, from its syntax nodes; arrow functions bear the name they are assigned to.

    A file that does not parse gives one row with the line and message of its first error, and never stops the
    others; null and blank contents give no rows.
    """

    def one(sid, repo, path, content):
        ext = grammar.extension(path)
        if not content or grammar.blank(ext, content):
            return []
        p = grammar.parse(ext, content)
        if p.errors:
            at, what = p.errors[0]
            return [(sid, repo, path, None, None, None, p.line(at), None, None, what)]
        starts, ends = p.positions()
        text, out = p.text, []
        breaks = [m.start() for m in re.finditer("\n", text)]
        for f in sorted(p.funcs, key=lambda f: f.start):
            name = text[starts[f.name] : ends[f.name]]
            owner = text[starts[f.owner] : ends[f.owner]] if f.owner >= 0 else ""
            first, last = bisect_left(breaks, starts[f.start]) + 1, bisect_left(breaks, ends[f.end - 1]) + 1
            signature = re.sub(r"\s+", " ", text[starts[f.start] : ends[f.head - 1]]).strip()
            out.append((sid, repo, path, "method" if owner else "function", name, f"{path}:{owner}.{name}" if owner else f"{path}:{name}", first, last, signature, None))
        return out

    known = F.lower(F.element_at(F.split("file_path", r"\."), -1)).isin(*[x for x in grammar.PARSERS if x != "json"])
    return each(files.where(known).select("snapshot_id", "repo_id", "file_path", "content"), one, SYMBOLS)


OUTLINE = re.compile(r"^(?P<indent>[ \t]*)(?:(?P<cls>class)\s+(?P<c>\w+)|(?:async\s+)?def\s+(?P<f>\w+))", re.M)


def python_outline_short(files: DataFrame) -> DataFrame:
    """Symbols of Python files under bare names: classes with their bases and children, `Class.method`, functions, and constants in capitals as variables.

    A file that does not parse is outlined by its lines instead (`is_fallback`): there a definition that is
    indented under a class is taken for one of its methods, and nothing else is known of it.
    """

    def signature(c) -> str:
        if isinstance(c, ast.ClassDef):
            bases = ", ".join(ast.unparse(b) for b in c.bases)
            return f"class {c.name}({bases})" if bases else f"class {c.name}"
        back = f" -> {ast.unparse(c.returns)}" if c.returns else ""
        return f"{'async ' if isinstance(c, ast.AsyncFunctionDef) else ''}def {c.name}({ast.unparse(c.args)}){back}"

    def nodes(body, parent):
        for c in body:
            if isinstance(c, ast.ClassDef):
                inner = [m.name for m in c.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
                yield "class", c.name, c.lineno, c.end_lineno, signature(c), ast.get_docstring(c), parent, inner, False
                yield from nodes(c.body, c.name)
            elif isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{parent}.{c.name}" if parent else c.name
                yield "method" if parent else "function", name, c.lineno, c.end_lineno, signature(c), ast.get_docstring(c), parent, [], False
            elif isinstance(c, ast.Assign) and not parent:
                for t in c.targets:
                    if isinstance(t, ast.Name) and t.id.isupper():
                        yield "variable", t.id, c.lineno, c.end_lineno, None, None, None, [], False

    def lines(text):
        owner, depth = None, -1
        for m in OUTLINE.finditer(text):
            n, line = len(m["indent"].expandtabs()), text.count("\n", 0, m.start()) + 1
            if n <= depth:
                owner, depth = None, -1
            if m["cls"]:
                yield "class", m["c"], line, line, m.group().strip(), None, None, [], True
                owner, depth = m["c"], n
            elif owner:
                yield "method", f"{owner}.{m['f']}", line, line, m.group().strip(), None, owner, [], True
            else:
                yield "function", m["f"], line, line, m.group().strip(), None, None, [], True

    def one(sid, path, content):
        try:
            return [(sid, path, *x) for x in nodes(tree(content).body, None)]
        except BROKEN:
            return [(sid, path, *x) for x in lines(content or "")]

    return each(files.where(F.col("file_path").endswith(".py")).select("snapshot_id", "file_path", "content"), one, SHORT)


# fixed values: signs of frameworks in file paths, in the order in which they are tried
FRAMEWORKS = [("laravel", "artisan"), ("laravel", "app/http/controllers"), ("laravel", "routes/web.php"), ("django", "manage.py"), ("django", "wsgi.py"), ("django", "settings.py"), ("fastapi", "main.py"), ("fastapi", "uvicorn"), ("flask", "app.py"), ("flask", "flask"), ("express", "package.json"), ("express", "express"), ("nextjs", "next.config"), ("nextjs", "_app.tsx"), ("nextjs", "_app.js"), ("react", "react-dom"), ("vue", "vue.config.js"), ("vue", "nuxt.config"), ("rails", "gemfile"), ("rails", "config/routes.rb"), ("spring", "pom.xml"), ("spring", "build.gradle")]


# fixed values: frameworks by the name of an imported module, in the order in which they are tried
IMPORTED = [("fastapi", "fastapi"), ("flask", "flask"), ("django", "django"), ("express", "express"), ("nextjs", "next"), ("react", "react")]


def frameworks(files: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """The first framework whose sign stands in a path of the repository, else the first whose name an imported module holds; unknown if none does. imported(repo_id, module)."""
    low = F.lower("file_path")
    found = F.array_compact(F.array(*[F.when(low.contains(s), F.lit(k)) for k, (_, s) in enumerate(FRAMEWORKS)]))
    best = files.groupBy("repo_id").agg(F.min(F.array_min(found)).alias("k"))
    names = F.array(*[F.lit(n) for n, _ in FRAMEWORKS])
    if imported is None:
        return best.select("repo_id", F.coalesce(F.get(names, F.col("k")), F.lit("unknown")).alias("framework"))
    module = F.lower("module")
    named = F.array_compact(F.array(*[F.when(module.contains(s), F.lit(k)) for k, (_, s) in enumerate(IMPORTED)]))
    second = imported.groupBy("repo_id").agg(F.min(F.array_min(named)).alias("i"))
    others = F.array(*[F.lit(n) for n, _ in IMPORTED])
    return best.join(second, "repo_id", "left").select("repo_id", F.coalesce(F.get(names, F.col("k")), F.get(others, F.col("i")), F.lit("unknown")).alias("framework"))
