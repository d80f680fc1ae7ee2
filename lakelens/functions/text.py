"""Lines, paths, snippets, hashes and redaction as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: token shapes removed from stored snippets
TOKENS = [
    r"ghp_[a-zA-Z0-9]{36,}", r"github_pat_[a-zA-Z0-9_]{22,}", r"ghu_[a-zA-Z0-9]{36,}", r"ghs_[a-zA-Z0-9]{36,}", r"gho_[a-zA-Z0-9]{36,}",
    r"xoxb-[a-zA-Z0-9-]+", r"xoxp-[a-zA-Z0-9-]+", r"AKIA[0-9A-Z]{16}", r"sk-[a-zA-Z0-9]{48,}", r"glpat-[a-zA-Z0-9_-]{20,}",
    r"(?i)(api_key|secret|token|password)\s*=\s*[\"'][^\"']+[\"']",
]


def lines_nl(text) -> Column:
    """Lines ended by LF only."""
    return F.split(text, "\n", -1)


def lines_universal(text) -> Column:
    """Lines as universal newlines cut them: no empty last line, CR and CRLF count, form feed and U+2028 too."""
    got = F.split(F.regexp_replace(text, r"\r\n?|[\x0b\x0c\x1c-\x1e\u0085  ]", "\n"), "\n", -1)
    return F.when(F.element_at(got, -1) == "", F.slice(got, 1, F.size(got) - 1)).otherwise(got)


def basename(path) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def normpath(path) -> Column:
    """Without empty parts and `.`, and with `..` taking away the part before it; an empty path is `.`."""
    rooted = path.startswith("/")
    up = lambda a: (a == "") | a.endswith("/..") | (a == "..")
    step = lambda a, x: F.when(x.isin("", "."), a).when((x == "..") & ~up(a), F.regexp_replace(a, r"(?:^|/)[^/]+$", "")).when((x == "..") & rooted & (a == ""), a).when(a == "", x).otherwise(F.concat(a, F.lit("/"), x))
    flat = F.aggregate(F.split(path, "/"), F.lit(""), step)
    return F.when(rooted, F.concat(F.lit("/"), flat)).when(flat == "", ".").otherwise(flat)


def join_path(first, second) -> Column:
    """The second path below the first one; alone if it starts at the root."""
    return F.when(second.startswith("/"), second).when((first == "") | first.endswith("/"), F.concat(first, second)).otherwise(F.concat(first, F.lit("/"), second))


def is_upper(text) -> Column:
    return text.rlike("[A-Z]") & (text == F.upper(text))


def owner_and_name(url) -> Column:
    """Owner and name in the address of a repository, in its https or its ssh form; null in any other."""
    web, ssh = r"[\w.-]+\.[a-z]+/([^/]+)/([^/]+?)(?:\.git)?(?:/.*)?$", r"[\w.-]+\.[a-z]+:([^/]+)/([^/]+?)(?:\.git)?$"
    pick = lambda k: F.when(url.rlike(web), F.regexp_extract(url, web, k)).when(url.rlike(ssh), F.regexp_extract(url, ssh, k))
    return F.struct(pick(1).alias("owner"), pick(2).alias("name"))


def suffix(path) -> Column:
    """Lower-case extension with its dot; a leading dot alone is none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def strip_end(text, chars: str) -> Column:
    """Without any of some characters at the end, in whatever order they stand there."""
    return F.rtrim(text, F.lit(chars))


def strip_start(text, chars: str) -> Column:
    return F.ltrim(text, F.lit(chars))


def strip_both(text, chars: str) -> Column:
    return F.trim(text, F.lit(chars))


def newlines(text) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def redact_tokens(text) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, "[REDACTED]"), TOKENS, text)


def mask(secret) -> Column:
    """Long values keep four characters at both ends, short ones two in front; the length stays."""
    n = F.length(secret)
    return F.when(n > 12, F.concat(F.left(secret, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(secret, F.lit(4)))).otherwise(F.concat(F.left(secret, F.lit(2)), F.repeat(F.lit("*"), n - 2)))


def cap(text, n: int, tail: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(tail))).otherwise(text)


def squash(text) -> Column:
    """White space runs become one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def match_lines(hits, parts) -> Column:
    """Lines of the matches of a pattern, given the matches and the parts of the text between them: one pass that sums up the line breaks before each match."""
    before = F.slice(parts, 1, F.size(hits))
    steps = F.zip_with(before, hits, lambda s, h: F.struct(newlines(s).alias("s"), newlines(h).alias("h")))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("lines"))
    walk = lambda a, x: F.struct((a["at"] + x["s"] + x["h"]).alias("at"), F.array_append(a["lines"], a["at"] + x["s"]).alias("lines"))
    return F.aggregate(steps, start, walk, lambda a: a["lines"])


def path_skip_reason(path, size) -> Column:
    """Why a file is left out of analysis: the first reason that holds, or null."""
    low, ext, name = F.lower(path), suffix(path), basename(path)
    vendor = reduce(lambda a, b: a | b, [low.contains(f"/{d}/") | low.startswith(f"{d}/") for d in SKIP_DIRS])
    return (
        F.when(size > 1024 * 1024, "too_large")
        .when(ext.isin(*BINARY), "binary")
        .when(reduce(lambda a, b: a | b, [name.endswith(s) for s in BUNDLES]), "minified_or_bundle")
        .when(vendor, "vendor_or_build_dir")
        .when(~ext.isin(*PARSEABLE, *CONFIG), "unsupported_language")
    )


def language_of(path) -> Column:
    pairs = [x for kv in PARSEABLE.items() for x in kv]
    return F.try_element_at(F.create_map(*map(F.lit, pairs)), suffix(path))


# fixed values: file kinds by extension and folder
PARSEABLE = {".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".php": "php", ".rb": "ruby", ".go": "go", ".java": "java", ".rs": "rust", ".c": "c", ".cpp": "cpp", ".cs": "csharp"}
CONFIG = [".json", ".yaml", ".yml", ".toml", ".ini", ".env", ".txt", ".md"]
LISTED = [".py", ".js", ".ts", ".tsx", ".jsx", ".php", ".rb", ".java", ".go", ".env", ".yaml", ".yml", ".json", ".sql", ".sh", ".rs", ".c", ".cpp", ".pem", ".key"]
ALWAYS = [".env", "Gemfile.lock", "package-lock.json", "composer.lock", "yarn.lock"]
SKIP_DIRS = [".git", "__pycache__", ".venv", "venv", "node_modules", "vendor", "dist", "build", ".next", ".nuxt", "coverage", ".pytest_cache", ".mypy_cache", "eggs", ".eggs"]
BUNDLES = [".min.js", ".bundle.js", ".map"]
BINARY = [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".exe", ".dll", ".so", ".dylib", ".bin", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".db", ".sqlite", ".sqlite3"]
CODE = [".py", ".js", ".ts", ".jsx", ".tsx", ".php", ".rb", ".java", ".go", ".rs", ".cs", ".vue", ".svelte", ".blade.php"]


def is_code(path) -> Column:
    return reduce(lambda a, b: a | b, [path.endswith(s) for s in CODE])


def visibility(name) -> Column:
    return F.when(name.startswith("_"), "private").otherwise("public")
