"""Routes declared in PHP route files: verbs, resources, and groups with inherited prefixes and middleware."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

ROUTES = "snapshot_id long, file_path string, method string, uri string, controller string, action string, name string, middleware array<string>"
VERBS = {"get": ["GET"], "post": ["POST"], "put": ["PUT"], "patch": ["PATCH"], "delete": ["DELETE"], "options": ["OPTIONS"], "any": ["ANY"]}
# fixed values: what a resource stands for
RESOURCE = [("GET", "", "index"), ("GET", "/create", "create"), ("POST", "", "store"), ("GET", "/{id}", "show"), ("GET", "/{id}/edit", "edit"), ("PUT", "/{id}", "update"), ("DELETE", "/{id}", "destroy")]
WITHOUT_FORMS = [r for r in RESOURCE if r[2] not in ("create", "edit")]
TOKEN = re.compile(r"//[^\n]*|#(?!\[)[^\n]*|/\*[\s\S]*?\*/|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[A-Za-z_]\w*|->|::|=>|[^\s]")


def tokens(text: str) -> list[str]:
    return [t for t in TOKEN.findall(text) if not t.startswith(("//", "/*")) and not (t[0] == "#" and len(t) > 1)]


def closing(toks: list[str], at: int) -> int:
    """Index of the bracket that closes the one at `at`, or the end."""
    depth = 0
    for k in range(at, len(toks)):
        depth += (toks[k] in "([{") - (toks[k] in ")]}") if len(toks[k]) == 1 else 0
        if depth == 0:
            return k
    return len(toks)


def strings(part: list[str]) -> list[str]:
    return [t[1:-1] for t in part if t[:1] in "'\"" and len(t) > 1]


def chain(toks: list[str], at: int) -> tuple[list[tuple[str, list[str]]], int]:
    """Calls of `Route::a(..)->b(..)` from `at`: names with their argument tokens, and where it ends."""
    calls, k = [], at
    while k + 2 < len(toks) and toks[k] in ("::", "->") and toks[k + 2] == "(":
        e = closing(toks, k + 2)
        calls.append((toks[k + 1].lower(), toks[k + 3 : e]))
        k = e + 1
    return calls, k


def join(prefix: str, uri: str) -> str:
    return "/" + "/".join(p for p in (prefix.strip("/"), uri.strip("/")) if p)


def walk(toks: list[str], prefix: str, middleware: list[str], controller: str | None):
    k = 0
    while k < len(toks):
        if toks[k] != "Route":
            k += 1
            continue
        calls, k = chain(toks, k + 1)
        own, near, holder, name = list(middleware), prefix, controller, None
        for c, args in calls:
            if c == "middleware":
                own += strings(args)
            elif c == "prefix":
                near = join(near, (strings(args) or [""])[0])
            elif c == "name" or c == "as":
                name = (name or "") + (strings(args) or [""])[0]
            elif c == "controller":
                holder = args[0] if args else None
        for c, args in calls:
            said = strings(args)
            if c == "group":
                if "[" in args[:1]:  # an array of attributes stands first
                    e = closing(args, 0)
                    head = args[1:e]
                    for i, t in enumerate(head):
                        if t.strip("'\"") == "prefix" and "=>" in head[i + 1 : i + 2]:
                            near = join(near, head[i + 2].strip("'\""))
                        elif t.strip("'\"") == "middleware" and "=>" in head[i + 1 : i + 2]:
                            v = head[i + 2 :]
                            own += strings(v[: closing(v, 0) + 1] if v[:1] == ["["] else v[:1])
                body = next((i for i, t in enumerate(args) if t == "{"), None)
                if body is not None:
                    yield from walk(args[body + 1 : closing(args, body)], near, own, holder)
            elif c in VERBS or c == "match":
                verbs = VERBS.get(c)
                rest = args
                if c == "match":
                    e = closing(args, 0)
                    verbs, rest = [v.upper() for v in strings(args[:e])], args[e + 1 :]
                    said = strings(rest)
                uri, handler = said[0] if said else "", None
                action = None
                words = [t for t in rest if re.fullmatch(r"[A-Z]\w*", t)]
                if len(said) > 1 and "@" in said[1]:
                    handler, _, action = said[1].partition("@")
                elif words and "class" in rest:
                    handler, action = words[0], said[1] if len(said) > 1 else "__invoke"
                elif "function" in rest or "fn" in rest:
                    action = "closure"
                elif holder and len(said) > 1:
                    handler, action = holder, said[1]
                for v in verbs:
                    yield v, join(near, uri), handler, action, name, own
            elif c in ("resource", "apiresource"):
                uri = said[0] if said else ""
                handler = next((t for t in args if re.fullmatch(r"[A-Z]\w*", t)), said[1] if len(said) > 1 else None)
                for v, tail, action in RESOURCE if c == "resource" else WITHOUT_FORMS:
                    yield v, join(near, uri) + tail, handler, action, f"{uri.strip('/').replace('/', '.')}.{action}", own


def routes(files: DataFrame) -> DataFrame:
    """One row per route and verb; a null or empty content has none."""

    def run(batches):
        for b in batches:
            rows = []
            for sid, path, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(sid, path, *r) for r in walk(tokens(text or ""), "", [], None)]
            kinds = [pa.int64(), *[pa.string()] * 6, pa.list_(pa.string())]
            names = [x.split()[0] for x in ROUTES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return files.where("file_path LIKE '%.php' AND content LIKE '%Route::%'").select("snapshot_id", "file_path", "content").mapInArrow(run, ROUTES)
