"""Problem 5: source files that no one wrote by hand for their repository.

Method: models of the characters in identifiers are trained per language over all files whose
lines are not packed (counts of three-character runs over a small alphabet, so the table is
bounded), and profiles of naming styles (snake, camel, Pascal, upper, lower) are counted per
repository and language over all files. A file is then flagged
- minified, if its lines are packed and its names are mangled: their cross-entropy against the
  model of their language is over MANGLED bits a character;
- generated, if its names come from templates (low diversity once counting numbers are taken
  out), if its head declares in so many words that a tool wrote it, if a looser remark of that
  kind stands beside lines of little diversity, or if it is a lock file;
- data, if nearly all of its tokens are literals or records with the same keys;
- vendored, if its naming style is foreign to the rest of its repository, if the same code,
  comments aside, stands in several repositories, or if a banner with a release or its place
  names another project.

Two passes over the files. The first one shuffles counts that are aggregated in each task
(character runs: bounded; styles: five a repository and language; fingerprints: one row per
distinct file) and is written to the shared folder for its readers; the second one is a map with
the model broadcast (at most LIMIT entries a language, which the alphabet guarantees). The joins
on fingerprints and repositories are salted, so a third of all files being one copy, or of one
repository, makes no hot partition.

Defined cases: null or blank content is never flagged; a null path counts as no extension; a
null repository is one repository; repeated rows are judged alike and reported once in
unwritten_files; a style is judged from NAMED names on, against OTHERS of the repository.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grammar import extension
from .rows import kept, map_rows

ALPHABET = 29
LIMIT = ALPHABET**3
SALTS = 16
NAMES = 200_000
PACKED, MANGLED = 110, 3.4  # mean length of a line; bits a character of its names
NAMED, OTHERS, FOREIGN = 20, 400, 0.7  # names of a file and of the rest of its repository; distance of their styles, 0 to 1
STYLES = ("snake", "camel", "pascal", "upper", "lower")
CODE = {"py", "js", "ts", "php", "go", "java"}
FEATURES = "snapshot_id long, repo_id string, file_path string, ext string, styles array<long>, fingerprint string, generated boolean, minified boolean, data boolean, foreign boolean, cross_entropy double, diversity double"

IDENT = re.compile(r"\b[A-Za-z_$][\w$]*")
FOLD = str.maketrans({**{chr(c): chr(c + 32) for c in range(65, 91)}, **{str(d): "0" for d in range(10)}, "$": "_"})
NO_CODE = re.compile(r"\"\"\"(?:[^\"]|\"(?!\"\"))*+(?:\"\"\"|\Z)|\'\'\'(?:[^\']|\'(?!\'\'))*+(?:\'\'\'|\Z)|`(?:[^`\\]|\\.)*+`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|/\*(?:[^*]|\*(?!/))*\*/|//[^\n]*|(?m:^[ \t]*#(?!\[)[^\n]*)")
HEAD = re.compile(r"(?:\s|﻿|<\?php|#![^\n]*\n|/\*[\s\S]*?\*/|//[^\n]*|#[^\n]*|--[^\n]*|<!--[\s\S]*?-->)*")
# fixed values: what tools write at the head of their output, in several languages
MARKERS = re.compile(
    r"@generated\b|<auto-?generated|\b(?:auto(?:matically|[- ]?)?[- ]?generated|autogenerated|machine[- ]generated|code generated|file generated|generated (?:by|from|code|file|on|with|using|automatically))\b|\b(?:generated|produced|created|emitted|written) (?:automatically )?(?:by|from|with) (?:the )?(?:tool |compiler |generator )?[\w./-]+|do not (?:edit|modify|change)(?! here| this rule)(?=[^\n]{0,40}$)"
    r"|manual (?:edits|changes) (?:are|will be) (?:overwritten|lost)|regenerate (?:with|using|by)|edit the \S+ (?:file )?instead|changes (?:to this file )?(?:are|will be) (?:overwritten|lost)|^\W*source: \S+ \(\S+\)"
    r"|automatisch (?:erzeugt|generiert|erstellt)|nicht (?:bearbeiten|ändern|editieren)|produit par|généré|ne pas (?:modifier|éditer)|generado (?:por|automáticamente)|no (?:editar|modificar)|gerado (?:por|automaticamente)|não (?:editar|edite|modifi\w+)"
    r"|сгенерирован|создан автоматически|автоматически создан|не (?:редактировать|изменять|править)|自动生成|请勿(?:修改|编辑)|自動生成|編集しない|手動で編集|تم إنشاؤه|لا تعدل",
    re.I | re.M,
)
# fixed values: declarations of a tool, at the start of a comment line
DECLARED = re.compile(
    r"^\W*(?:@generated\b|<auto-?generated|(?:this|the) (?:file|code|module|class)\b[^\n.]{0,40}\bgenerated\b|(?:code|file) generated\b|auto(?:matically)?[- ]?generated\b|machine[- ]generated\b|generated (?:by|from|with|using|automatically|file|code)\b"
    r"|(?:produced|created|emitted|written) (?:automatically )?(?:by|from|with)\b[^\n]*(?:edits|changes|overwritten|regenerate)|do not (?:edit|modify|change)\b|source: \S+ \(\S+\)"
    r"|(?:diese|die|der|dieser) (?:datei|code|klasse)\b[^\n.]{0,40}(?:erzeugt|generiert|erstellt)|automatisch (?:erzeugt|generiert|erstellt)|(?:ce )?(?:fichier|code)\b[^\n.]{0,30}(?:produit|généré)|(?:este )?(?:archivo|código)\b[^\n.]{0,40}generado|generado (?:por|automáticamente)|(?:este )?(?:arquivo|código)\b[^\n.]{0,40}gerado|gerado (?:por|automaticamente)"
    r"|(?:этот )?(?:файл|код)\b[^\n.]{0,40}(?:сгенерирован|создан)|сгенерирован|[^\n]{0,12}自动生成|[^\n]{0,16}自動生成|[^\n]{0,16}تم إنشاؤه)",
    re.I | re.M,
)
RELEASE = re.compile(r"\d+\.\d+")
COPIED = re.compile(r"vendored (?:copy|from|version)|\b(?:taken|copied|adapted|imported) from the [\w.-]+ (?:project|library|package)|upstream (?:version|project|revision)|\bthird[- ]party\b|(?:^|\n)\W*[\w@/.-]+ v?\d+\.\d+\.\d+\b", re.I)
LOCKS = re.compile(r"(?:^|/)(?:[\w.-]*[-.]lock(?:file)?(?:\.json|\.ya?ml)?|npm-shrinkwrap\.json|go\.sum|Pipfile\.lock|yarn\.lock|Cargo\.lock)$", re.I)
THIRD = re.compile(r"(?:^|/)(?:node_modules|third_party|third-party|site-packages|bower_components|external/[^/]+/?[\w-]*-\d|deps/[\w-]+-\d|vendor/[\w.-]+/[\w.-]+/)", re.I)
NUMBERED = re.compile(r"^(\D*?)(\d+)$")
LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|-?\b\d[\w.]*|\b(?:true|false|null|None|True|False|nil)\b")
KEYS = re.compile(r"\"([^\"\\\n]{1,60})\"\s*:")


def bare(text: str) -> str:
    """The code without comments and without what stands in quotes."""
    return NO_CODE.sub(" ", text)


def headed(text: str) -> tuple[str, str]:
    """The head of a file (what stands before its code) and the rest."""
    head = HEAD.match(text).group()
    return head, text[len(head) :]


def fingerprint(code: str) -> str | None:
    """Of bare code long enough to be told from chance, white space aside."""
    code = "".join(code.split())
    return hashlib.blake2b(code.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if len(code) >= 160 else None


def runs(name: str) -> list[str]:
    s = "^" + name.translate(FOLD) + "^"
    return [s[k : k + 3] for k in range(len(s) - 2)]


def names_of(text: str) -> set[str]:
    return {w for w in IDENT.findall(text) if w.isascii()}


def style_of(name: str) -> int | None:
    """Which of STYLES a name follows."""
    w = name.strip("_$")
    if not w:
        return None
    if w.isupper() and len(w) > 1:
        return 3
    if "_" in w:
        return 0
    if w[0].isupper():
        return 2
    return 1 if any(c.isupper() for c in w) else 4


def styles_of(names: set[str]) -> list[int]:
    out = [0] * len(STYLES)
    for w in names:
        k = style_of(w)
        if k is not None:
            out[k] += 1
    return out


def packed(code: str) -> bool:
    lines = [x for x in code.split("\n") if x.strip()]
    return sum(map(len, lines)) > PACKED * max(1, len(lines))


def _partial(batches):
    """One pass in a task: character runs by language, styles by repository and language, and fingerprints by repository."""
    import pyarrow as pa

    counts: dict[str, Counter] = {}
    seen: dict[str, Counter] = {}  # names with the number of files they stand in, folded into runs when they are many

    styles: dict[tuple[str, str], list[int]] = {}

    def fold(ext: str) -> None:
        own = counts.setdefault(ext, Counter())
        for w, n in seen.pop(ext).items():
            for k in runs(w):
                own[k] += n

    schema = pa.schema([("kind", pa.string()), ("key", pa.string()), ("n", pa.int64()), ("low", pa.string()), ("high", pa.string())])
    for b in batches:
        rows = []
        for repo, path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
            ext = extension(path)
            if not content or not content.strip() or ext not in CODE:
                continue
            code = bare(headed(content)[1])
            names = names_of(code)
            if not packed(code):
                own = seen.setdefault(ext, Counter())
                own.update(names)
                if len(own) > NAMES:
                    fold(ext)
            sums = styles.setdefault((ext, repo or ""), [0] * len(STYLES))
            for k, n in enumerate(styles_of(names)):
                sums[k] += n
            if len(styles) > NAMES:
                rows += [("style", f"{e} {k} {r}", n, r, e) for (e, r), own in styles.items() for k, n in enumerate(own) if n]
                styles.clear()
            f = fingerprint(code)
            if f:
                rows.append(("copy", f, 1, repo or "", repo or ""))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    for ext in list(seen):
        fold(ext)
    rows = [("run", f"{ext} {k}", n, "", "") for ext, own in counts.items() for k, n in own.items()]
    rows += [("style", f"{e} {k} {r}", n, r, e) for (e, r), own in styles.items() for k, n in enumerate(own) if n]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def corpus_counts(files: DataFrame) -> DataFrame:
    """kind `run`: counts of character runs by language; kind `copy`: fingerprints with the first and last repository; kind `style`: names by language, style and repository (low) with the language (high)."""
    part = files.select("repo_id", "file_path", "content").mapInArrow(_partial, "kind string, key string, n long, low string, high string")
    return part.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def train(counts: DataFrame) -> dict[str, dict[str, float]]:
    """Bits of each character run given its first two characters, by language. At most LIMIT entries a language."""
    got: dict[str, Counter] = {}
    for r in counts.where("kind = 'run'").select("key", "n").collect():
        ext, run = r["key"].split(" ", 1)
        got.setdefault(ext, Counter())[run] = r["n"]
    out = {}
    for ext, own in got.items():
        first = Counter()
        for k, n in own.items():
            first[k[:2]] += n
        out[ext] = {k: -math.log2((n + 0.5) / (first[k[:2]] + 0.5 * ALPHABET)) for k, n in own.items()}
    return out


def entropy(names: set[str], model: dict[str, float], known: dict[str, tuple[float, int]]) -> float:
    """Mean bits a character of the names, unseen runs counting as rare; `known` keeps names that were weighed with this model."""
    bits = size = 0
    for w in names:
        got = known.get(w)
        if got is None:
            r = runs(w)
            if len(known) > NAMES:
                known.clear()
            got = known[w] = (sum(model.get(k, 9.0) for k in r), len(r))
        bits += got[0]
        size += got[1]
    return bits / size if size else 0.0


def shapes_of(code: str) -> tuple[float, int]:
    """Share of different lines once names with counting numbers are one, and the number of lines."""
    shapes = [re.sub(r"\d+", "#", re.sub(r"\b[A-Za-z_$]*[A-Za-z_$]\d+", "N#", x.strip())) for x in code.split("\n") if x.strip()]
    return len(set(shapes)) / max(1, len(shapes)), len(shapes)


def template_share(names: set[str]) -> tuple[float, float]:
    """Share of names that carry a counting number, and how much of 0..n their numbers cover in one file."""
    numbers = [int(m[2]) for w in names if (m := NUMBERED.match(w)) and len(m[2]) < 6]
    if len(numbers) < 6 or not names:
        return 0.0, 0.0
    own = set(numbers)
    top = max(own) + 1
    return len(numbers) / len(names), len(own) / top


def judge(path: str | None, text: str | None, models: dict[str, dict[str, float]], known: dict[str, dict] | None = None) -> tuple[bool, bool, bool, bool, float, float]:
    """generated, minified, data, foreign by banner or place, cross-entropy, diversity."""
    return evidence(path, text, models, known)[0]


def evidence(path: str | None, text: str | None, models: dict[str, dict[str, float]], known: dict[str, dict] | None = None) -> tuple[tuple[bool, bool, bool, bool, float, float], str, set[str]]:
    """What `judge` says, with the bare code behind the head and its names."""
    path, ext = path or "", extension(path)
    if not text or not text.strip():
        return (False, False, False, False, 0.0, 1.0), "", set()
    head, code = headed(text)
    stripped = bare(code) if ext in CODE else code
    words = [w for w in IDENT.findall(stripped) if w.isascii()] if ext in CODE else []
    names = set(words)
    bits = entropy(names, models[ext], {} if known is None else known.setdefault(ext, {})) if ext in models and names else 0.0
    size = len(code.strip()) or 1
    generated = bool(LOCKS.search(path) or DECLARED.search(head))
    if ext == "json" and not generated:
        generated = '"lockfileVersion"' in text or text.count('"integrity"') >= 5 and text.count('"resolved"') + text.count('"version"') >= 5
    share, cover = template_share(names)
    remark = not generated and MARKERS.search(head) is not None
    diversity, lines = shapes_of(stripped) if share > 0.3 and cover > 0.6 or remark else (1.0, 0)
    if share > 0.3 and cover > 0.6:
        generated = generated or share > 0.5 or diversity < 0.35 and lines >= 8
    generated = generated or remark and (share > 0.1 or diversity < 0.35 and lines >= 8)
    minified = ext in CODE and size > 300 and packed(stripped) and (stripped.count(" ") + stripped.count("\n")) / len(stripped) < 0.12 and bits > MANGLED
    data = False
    named = sum(map(len, words))
    if ext == "json" and not generated:
        literals = LITERAL.findall(code)
        keys = Counter(KEYS.findall(code))
        top = keys.most_common(1)[0][1] if keys else 0
        values = len(literals) - sum(keys.values())
        even = sum(1 for n in keys.values() if n >= 0.8 * top)
        data = not keys and (values >= 60 or size > 1500) or top >= 12 and len(keys) <= 12 and even >= max(2, 0.6 * len(keys))
    elif ext in CODE and named <= 0.03 * size and size > 300 and len(names) <= 12:  # a long string among code is no data file
        literals = LITERAL.findall(code)
        held = sum(map(len, literals))
        punct = sum(c in " \t\r\n,[](){};:=>+." for c in LITERAL.sub("", code))
        data = held + punct >= 0.9 * (size - named) and (len(literals) >= 30 or held >= 800) and (held >= 0.35 * size or len(literals) >= 60)
    foreign = bool(THIRD.search(path)) or any(RELEASE.search(line_at(head, m.end())) for m in COPIED.finditer(head))
    return (generated, minified, data, foreign, bits, diversity), stripped, names


def line_at(text: str, at: int) -> str:
    stop = text.find("\n", at)
    return text[text.rfind("\n", 0, at) + 1 : len(text) if stop < 0 else stop]


def _judge(models):
    def make():
        m, known = models.value, {}

        def one(snapshot_id, repo_id, path, content):
            (generated, minified, data, foreign, bits, diversity), code, names = evidence(path, content, m, known)
            ext = extension(path)
            own = bool(code) and ext in CODE
            yield snapshot_id, repo_id, path, ext, styles_of(names) if own else None, fingerprint(code) if own else None, generated, minified, data, foreign, bits, diversity

        return one

    return make


def foreign_style(own: str = "styles", every: str = "profile") -> Column:
    """Are a file's naming styles far from those of the rest of its repository and language?"""
    total = lambda a: f"aggregate({a}, 0L, (x, y) -> x + y)"
    rest = f"zip_with({every}, {own}, (x, y) -> x - y)"
    far = f"0.5 * aggregate(zip_with({own}, {rest}, (x, y) -> abs(x / {total(own)} - y / {total(rest)})), 0D, (x, y) -> x + y)"
    return F.coalesce(F.expr(f"{total(own)} >= {NAMED} AND {total(rest)} >= {OTHERS} AND {far} >= {FOREIGN}"), F.lit(False))


def judged(files: DataFrame) -> DataFrame:
    """Every file with the evidence against it and the verdict `origin` (null: hand-written)."""
    counts = kept(corpus_counts(files))
    models = files.sparkSession.sparkContext.broadcast(train(counts))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    rows = map_rows(files.select("snapshot_id", "repo_id", "file_path", "content"), _judge(models), FEATURES)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("snapshot_id"), F.lit(SALTS)).cast("int")).withColumn("repo", F.coalesce("repo_id", F.lit("")))
    copies = counts.where("kind = 'copy' AND low <> high").select(F.col("key").alias("fingerprint"), salts, F.lit(True).alias("copied"))
    style = F.split("key", " ", 3)
    number = [F.sum(F.when(style[1] == str(k), F.col("n")).otherwise(0)) for k in range(len(STYLES))]
    profiles = counts.where("kind = 'style'").groupBy(F.col("low").alias("repo"), F.col("high").alias("ext")).agg(F.array(*number).alias("profile")).select("repo", "ext", "profile", salts)
    both = rows.join(copies, ["fingerprint", "salt"], "left").join(profiles, ["repo", "ext", "salt"], "left").withColumn("copied", F.coalesce("copied", F.lit(False))).withColumn("foreign_names", foreign_style())
    origin = F.when(F.col("generated"), "generated").when(F.col("minified"), "minified").when(F.col("data"), "data").when(F.col("copied") | F.col("foreign") | F.col("foreign_names"), "vendored")
    return both.select("snapshot_id", "repo_id", "file_path", origin.alias("origin"), "cross_entropy", "diversity", "copied", "foreign", "foreign_names")


def unwritten_files(files: DataFrame) -> DataFrame:
    return judged(files).where(F.col("origin").isNotNull()).select("snapshot_id").distinct()
