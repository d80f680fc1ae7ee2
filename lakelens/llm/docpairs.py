"""Problem 3: functions paired with their documentation.

Files that parse are visited node by node: each function or method node of the syntax tree
gives its name, signature, exact body range and the documentation attached to it (docstring,
the last block comment of the documentation kind before it, or the line comments directly
above). Pairs whose documentation is empty, a placeholder, a pointer, bare tags or only the
words of the name are left out. One map over the files, no shuffle but the final distinct.

Defined cases: null or blank content, unknown extensions and broken files give no pairs; a
function without a name (anonymous) gives none; repeated rows give one pair each in
documented_functions and one row in documented_keys; texts are taken whole.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grammar import PARSERS, blank, extension, parse
from .rows import map_rows
from .syntax import known_extension

PAIRS = "snapshot_id long, repo_id string, file_path string, line_no long, name string, qualified_name string, kind string, signature string, docstring string, body string, start_pos long, end_pos long"

# fixed values: what a documentation says that says nothing yet, or only points elsewhere
PLACEHOLDERS = """
n/a | na | none | null | nil | tbd | tba | wip | todo | fixme | xxx | hack | doc | docs | documentation | description | summary | placeholder | undocumented | untitled | test | helper | helper function | helper method | internal | internal use | internal use only | private | constructor | getter | setter | function | method | class | module | init | initialize | main | entry point | utility | util | misc
no docs | no doc | no description | no documentation | no comment | no comments | not documented | not documented yet | missing documentation | no docstring | description here | add description | add description here | add docs | your description here | enter description | insert description here | description goes here | docstring | fill in later | fill me in | fill this in | write me | document me | document this | to be documented | to be written | to be done | to do | to be defined | to be added | coming soon | documentation follows | docs to follow | documentation to come | more later | later
auto-generated method stub | autogenerated method stub | auto generated method stub | generated stub | auto-generated stub | auto-generated | autogenerated | generated | generated method | stub | method stub | generated code | generated by ide | lorem ipsum | summary_ | description_ | type_ | short description | one-line summary | brief description
see above | see below | see base class | see parent | see super | see superclass | see interface | see docs | see documentation | see readme | see wiki | see signature | same as above | same as base class | same as base | same as parent | same as super | as above | ditto | inherited | inherit doc | inheritdoc | overrides parent | override | overridden | parameters see signature | parameters: see signature | refer to docs | idem
noch offen | offen | folgt | folgt noch | beschreibung folgt | keine beschreibung | noch zu beschreiben | noch zu dokumentieren | fehlt noch | siehe oben | siehe basisklasse | pendiente | por hacer | por completar | sin descripción | sin documentación | completar | ver arriba | à compléter | a compléter | à faire | à décrire | à documenter | sans description | voir plus haut | voir ci-dessus | a preencher | a fazer | pendente | por fazer | sem descrição | descrever | ver acima | дописать | описать | нет описания | без описания | сделать | позже | см. выше | заполнить | допишу позже
暂无 | 暂无说明 | 暂无描述 | 待补充 | 待完善 | 待写 | 待定 | 无 | 略 | 同上 | 见上 | 未记入 | 未記入 | 後で書く | あとで書く | 説明なし | 説明 | 未定 | 準備中 | 同上 | 要追記 | लिखना बाकी | बाद में | قيد الكتابة | لاحقا | يتبع | รอเพิ่ม | ยังไม่ได้เขียน
"""
EMPTY_SAYINGS = {x.strip() for x in re.split(r"[|\n]", PLACEHOLDERS) if x.strip()}
# fixed values: words that add nothing to a name
FILLER = set("a an the this that of for to and or is are it in on with by as from method methods function functions func constructor class getter setter helper utility handler implementation returns return def void".split())
MARK = re.compile(r"^\W*(?:todo|fixme|xxx|tbd|hack|wip)\b", re.I)
POINTER = re.compile(r"^(?:see(?: also)?|cf\.?|compare|refer to|same as|as in|like|siehe(?: auch)?|vgl\.?|wie|voir|ver|véase|см\.?|参见|参照|详见|参照先)\b[:\s]*", re.I)
TAG = re.compile(
    r"^\s*(?:[@\\](?P<at>[A-Za-z]+)|:(?P<rst>param|type|return|returns|rtype|raises|raise|arg|argument|keyword|yields|var|ivar)\b(?P<name>[^:\n]*):)\s*(?P<rest>.*)$"
)
SECTION = re.compile(r"^\s*(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields?|Throws|Notes?|Examples?|Attributes|Kwargs|Keyword Args|See Also|-{3,}|={3,})\s*:?\s*$")
ITEM = re.compile(r"^\s*\*{0,2}[A-Za-z_]\w*(?:\s*\([^)]*\))?\s*:\s*(.*)$")
HTML = re.compile(r"</?[A-Za-z][^<>]*>")
SENTENCE = re.compile(r"(?<=[.!?。!?।؟])\s+|\n+")
WORD = re.compile(r"[^\W\d_]+")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+")
NAMED_TAGS = {"param", "arg", "argument", "type", "var", "property", "template", "typeparam", "prop"}
POINTER_TAGS = {"see", "inheritdoc", "link", "override", "overrides", "deprecated", "since", "author", "version", "internal", "private", "public", "protected", "api", "ignore", "hidden", "test"}


def clean_block(comment: str) -> str:
    """Text of a block comment without its frame."""
    return "\n".join(re.sub(r"^\s*\*+ ?", "", x).rstrip() for x in comment[3:-2].split("\n")).strip()


def clean_lines(comments: list[str]) -> str:
    return "\n".join(re.sub(r"^//+ ?", "", c).rstrip() for c in comments).strip()


def name_words(name: str) -> set[str]:
    return {w.lower() for w in CAMEL.findall(name)} | {name.lower().strip("_")}


def trivial(doc: str | None, name: str, params: set[str] = frozenset()) -> bool:
    """Does the documentation say nothing beyond name and signature? Null and blank texts are trivial."""
    if not doc:
        return True
    said, in_section = [], False
    for line in HTML.sub(" ", doc.replace("{@inheritDoc}", " ").replace("{@inheritdoc}", " ")).split("\n"):
        m = TAG.match(line)
        if m:
            tag, rest = (m["at"] or m["rst"]).lower(), m["rest"]
            if tag in POINTER_TAGS and tag != "deprecated":
                continue
            rest = re.sub(r"^\{[^}]*\}\s*", "", rest)
            if m["at"] and tag in NAMED_TAGS:
                rest = re.sub(r"^(?:[\w\\|<>\[\],?]+\s+)?\$?\[?[\w.$]+(?:=[^\]]*)?\]?\s*[-–:]?\s*", "", rest, count=1) if "$" in rest else re.sub(r"^\[?[\w.$]+(?:=[^\]]*)?\]?\s*[-–:]?\s*", "", rest, count=1)
            elif m["rst"] in ("rtype", "type") or tag in ("return", "returns", "throws", "exception") and re.fullmatch(r"[\w\\|<>\[\],?.]*", rest):
                rest = ""
            said.append(rest)
            continue
        if SECTION.match(line):
            in_section = True
            continue
        if in_section:
            i = ITEM.match(line)
            if i:
                said.append(i[1])
                continue
        said.append(line)
    known = name_words(name) | {p.lower() for p in params}
    for s in SENTENCE.split("\n".join(said)):
        s = s.strip().strip("`*_#\"'")
        if not s or MARK.match(s):
            continue
        flat = re.sub(r"[\s]+", " ", s.lower()).strip(" .!?:;,…-–—=~*()[]{}<>。、!?\"'`_/|\\+#")
        if not flat or flat in EMPTY_SAYINGS:
            continue
        words = [w for w in WORD.findall(s)]
        if not words:
            continue
        if POINTER.match(s) and len(words) <= 6:
            continue
        pieces = [p.lower() for w in words for p in (CAMEL.findall(w) or [w])]
        if all(p in known or p in FILLER for p in pieces):
            continue
        return False
    return True


def comments_before(p, start: int, name: int) -> list[tuple[int, str]]:
    """Comment tokens between the node's predecessor and its name, with their offsets."""
    kept, toks = p.kept_once(), p.toks
    lo = next((kept[k] for k in range(start - 1, -1, -1) if kept[k] >= 0), -1)
    hi = kept[name]
    starts = p.positions()[0]
    at = starts[name] - sum(map(len, toks[lo + 1 : hi]))
    out = []
    for t in toks[lo + 1 : hi]:
        if t[:2] in ("//", "/*") and len(t) > 1:
            out.append((at, t))
        at += len(t)
    return out


def documentation(ext: str, p, f) -> str | None:
    starts, ends = p.positions()
    if ext == "py":
        if f.doc < 0:
            return None
        try:
            got = ast.literal_eval(p.text[starts[f.doc] : ends[f.doc]].replace("\r\n", "\n"))
        except (ValueError, SyntaxError):
            return None
        return got if isinstance(got, str) else None
    if ext == "go":
        lines, at = [], starts[f.start]
        for pos, t in reversed(comments_before(p, f.start, f.start)):
            between = p.text[pos + len(t) : at]
            own_line = not p.text[p.text.rfind("\n", 0, pos) + 1 : pos].strip()
            if not t.startswith("//") or between.count("\n") != 1 or not own_line:
                break
            lines.append(t)
            at = pos
        return clean_lines(lines[::-1]) if lines else None
    blocks = [t for _, t in comments_before(p, f.start, f.name) if t.startswith("/**") and len(t) > 4]
    return clean_block(blocks[-1]) if blocks else None


def _visitor(with_text: bool):
    def make():
        def one(snapshot_id, repo_id, path, content):
            ext = extension(path)
            if ext == "json" or blank(ext, content):
                return
            p = parse(ext, content)
            if p.errors or not p.funcs:
                return
            starts, ends = p.positions()
            text = p.text
            breaks = [m.start() for m in re.finditer("\n", text)]
            for f in sorted(p.funcs, key=lambda f: f.start):
                doc = documentation(ext, p, f)
                if not doc:
                    continue
                name = text[starts[f.name] : ends[f.name]]
                head_end = ends[f.head - 1]
                if trivial(doc, name, set(re.findall(r"[^\W\d]\w*", text[ends[f.name] : head_end]))):
                    continue
                line = bisect_left(breaks, starts[f.name]) + 1
                if not with_text:
                    yield snapshot_id, line
                    continue
                owner = text[starts[f.owner] : ends[f.owner]] if f.owner >= 0 else ""
                first, k = starts[f.start], f.end - 1
                while k > f.head and not ends[k] > starts[k]:
                    k -= 1
                last = ends[k]
                yield (snapshot_id, repo_id, path, line, name, f"{owner}.{name}" if owner else name, f.kind,
                       re.sub(r"\s+", " ", text[first:head_end]).strip(), doc.strip(), text[first:last].rstrip(), first, last)

        return one

    return make


def _source(files: DataFrame) -> DataFrame:
    return files.where(known_extension() & F.col("content").isNotNull()).select("snapshot_id", "repo_id", "file_path", "content")


def documented_functions(files: DataFrame) -> DataFrame:
    """One row per function or method with non-trivial documentation."""
    return map_rows(_source(files), _visitor(True), PAIRS)


def documented_keys(files: DataFrame) -> DataFrame:
    """snapshot_id and line_no of the pairs, each once."""
    return map_rows(_source(files), _visitor(False), "snapshot_id long, line_no long").distinct()


__all__ = ["PARSERS", "documented_functions", "documented_keys", "trivial"]
