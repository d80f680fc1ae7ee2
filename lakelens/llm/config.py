"""Readers of configuration formats: every value with the path of its key and its place in the text.

JSON (also with comments and single quotes), YAML, and the line formats INI, TOML, properties
and env. All of them are tolerant: a text may start or stop anywhere, as snippets do, and what
does not fit a format is passed over. A reader goes through a text once; nothing is copied but
keys. A mapping that gives a name and then a value (`name: X`, `value: y`) counts as key and value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


DEPTH = 64  # innermost keys of a path that are kept


class Leaf(NamedTuple):
    path: tuple[str, ...]
    start: int
    end: int
    cut_off: bool  # the text ends inside the value, or right behind it


TOKEN = re.compile(r"\"(?:[^\"\\\n]|\\.)*+(?:\"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*+(?:'|(?=\n)|\Z)|//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)|(?<![^\s,{\[])#[^\n]*|[{}\[\],]|[:=](?=[\s\"'{\[])|[^\s{}\[\],\"'](?:[^{}\[\],\"'\n:=]|[:=](?![\s\"'{\[]))*+")
KEY_FOLLOWS = re.compile(r"\s*[:=](?=[\s\"'{\[]|\Z)")
NAMES, VALUES = {"name", "key", "id"}, {"value", "val", "default", "data"}
YAML_KEY = re.compile(r"(?:\"(?P<d>(?:[^\"\\\n]|\\.)*)\"|'(?P<s>[^'\n]*)'|(?P<p>[^\s\"'#{}\[\],&*!|>%@`-][^\n:#]*?|-[^\s:#][^\n:#]*?))[ \t]*:(?=[ \t\r\n]|\Z)[ \t]*")
YAML_LEAD = re.compile(r"(?:[!&][^\s]*[ \t]+)*")
BLOCK = re.compile(r"[|>][-+0-9]*[ \t]*(?:#[^\n]*)?\r?(?:\n|\Z)")
SECTION = re.compile(r"[ \t]*\[{1,2}[ \t]*(?P<name>[^\]\n]+?)[ \t]*\]{1,2}[ \t]*(?:[#;][^\n]*)?\r?$")
PAIR = re.compile(r"[ \t]*(?:(?:export|set|ENV|ARG|local|readonly)[ \t]+)?[\"']?(?P<key>[^\s=:\"'#;\[\]{}][^=:\"'\n]*?)[\"']?[ \t]*[=:](?!=)[ \t]*")
INNER_COMMENT = re.compile(r"[ \t]+[#;]")
DOUBLE, SINGLE = re.compile(r"\"(?:[^\"\\]|\\.)*+\"", re.S), re.compile(r"'(?:[^'\\]|\\.|'')*+'", re.S)
TRIPLE = ('"""', "'''")


def unquoted(token: str) -> str:
    return token[1:-1] if len(token) > 1 and token[0] in "\"'" and token[-1] == token[0] else token.strip("\"'")


def flow(text: str, at: int, end: int, path: tuple[str, ...]) -> Iterator[Leaf]:
    """Values of braces and brackets from `at` on; whatever stands outside of them is read as if they were open."""
    frames: list[list] = [["", None, None, 0]]  # mark, key, name given before, next index
    n = len(text)

    def place() -> tuple[str, ...]:
        out = list(path)
        for mark, key, name, index in frames[-DEPTH:]:
            if mark == "[":
                out.append(str(index))
            elif key is not None:
                out.append(name if name and key.lower() in VALUES else key)
        return tuple(out)

    for m in TOKEN.finditer(text, at, end):
        t, top = m.group(), frames[-1]
        if t[0] in "{[":
            frames.append([t, None, None, 0])
        elif t in ("}", "]"):
            if len(frames) > 1:
                frames.pop()
        elif t == ",":
            top[1] = None
            top[3] += 1
        elif t in (":", "=") or t.startswith(("//", "/*", "#")):
            continue
        elif top[0] != "[" and top[1] is None and KEY_FOLLOWS.match(text, m.end()):
            top[1] = unquoted(t.strip())
        else:
            quoted = t[0] in "\"'"
            closed = not quoted or len(t) > 1 and t[-1] == t[0]
            a, b = (m.start() + 1, m.end() - 1 if closed else m.end()) if quoted else (m.start(), m.start() + len(t.rstrip()))
            yield Leaf(place(), a, b, b >= n - (quoted and closed))
            if top[1] is not None and top[1].lower() in NAMES:
                top[2] = text[a:b]
            elif top[1] is not None and top[1].lower() in VALUES:
                top[2] = None
            top[1] = None


def balanced(text: str, at: int, stop: int, open_from: list[int]) -> int:
    """End of the braces or brackets that open at `at`; the end of the line if they never close, which is found out once."""
    depth = 0
    for m in TOKEN.finditer(text, at, stop if open_from else len(text)):
        depth += (m.group() in ("{", "[")) - (m.group() in ("}", "]"))
        if not depth:
            return m.end()
    open_from.append(at)
    return stop


def quoted(text: str, at: int, stop: int, path: tuple[str, ...]) -> tuple[Leaf, int]:
    """The value in quotes that starts at `at`, over lines if it closes only there, and where reading goes on."""
    n, mark = len(text), text[at]
    if text.startswith(TRIPLE, at):
        close = text.find(mark * 3, at + 3)
        return (Leaf(path, at + 3, n, True), n) if close < 0 else (Leaf(path, at + 3, close, False), close + 3)
    whole = (DOUBLE if mark == '"' else SINGLE).match(text, at)
    if whole and (whole.end() <= stop or ":" not in text[stop : whole.end()] and "=" not in text[stop : whole.end() - 1].strip().rstrip("=")):
        return Leaf(path, at + 1, whole.end() - 1, whole.end() >= n), whole.end()
    return Leaf(path, at + 1, stop, stop >= n), stop


def yaml(text: str) -> Iterator[Leaf]:
    """Values of a block of lines by indentation; braces and brackets inside are read as flow."""
    n, at = len(text), 0
    open_from: list[int] = []
    stack: list[tuple[int, str]] = []  # indentation and key
    named: dict[int, str] = {}  # indentation -> the name that the mapping gave before
    while at < n:
        stop = text.find("\n", at)
        stop = n if stop < 0 else stop
        line = text[at:stop]
        body = line.strip()
        if not body or body[0] == "#" or body in ("---", "..."):
            at = stop + 1
            continue
        p, dashed, key = at + len(line) - len(line.lstrip(" \t\ufeff")), False, ""
        while p < stop and text[p] == "-" and (p + 1 >= stop or text[p + 1] in " \t\r"):
            dashed = True
            while stack and stack[-1][0] > p - at:
                stack.pop()
            named = {k: v for k, v in named.items() if k <= p - at}
            p += 1
            while p < stop and text[p] in " \t\r":
                p += 1
        column = p - at
        m = YAML_KEY.match(text, p, stop) if p < stop else None
        if m or not dashed:
            while stack and stack[-1][0] >= column:
                stack.pop()
        if m:
            key = next(x for x in (m["d"], m["s"], m["p"]) if x is not None).strip()
            named = {k: v for k, v in named.items() if k <= column}
            stack.append((column, named.get(column, key) if key.lower() in VALUES else key))
            p = m.end()
        path = tuple(k for _, k in stack[-DEPTH:])
        p = YAML_LEAD.match(text, p, stop).end()
        at = stop + 1
        if p >= stop or text[p] in "#\r":
            continue
        if m and BLOCK.match(text, p):
            first, last, at = -1, -1, stop + 1
            while at < n:
                stop = text.find("\n", at)
                stop = n if stop < 0 else stop
                inner = text[at:stop]
                depth = len(inner) - len(inner.lstrip(" \t"))
                if inner.strip():
                    if depth <= column:
                        break
                    first, last = (at + depth if first < 0 else first), at + len(inner.rstrip())
                at = stop + 1
            if first >= 0:
                yield Leaf(path, first, last, last >= n - 1)
        elif text[p] in "\"'":
            leaf, end = quoted(text, p, stop, path)
            yield leaf
            if key.lower() in NAMES:
                named[column] = text[leaf.start : leaf.end]
            if end > stop:
                at = text.find("\n", end)
                at = n if at < 0 else at + 1
        elif text[p] in "{[":
            end = balanced(text, p, stop, open_from)
            yield from flow(text, p, end, path)
            if end > stop:
                at = text.find("\n", end)
                at = n if at < 0 else at + 1
        else:
            c = INNER_COMMENT.search(text, p, stop)
            value = text[p : c.start() if c else stop].rstrip()
            yield Leaf(path, p, p + len(value), p + len(value) >= n)
            if key.lower() in NAMES:
                named[column] = value


def pairs(text: str) -> Iterator[Leaf]:
    """Values of lines `key = value` or `key: value` under [sections], as in INI, TOML, properties and env."""
    n, at = len(text), 0
    open_from: list[int] = []
    section: tuple[str, ...] = ()
    name, waiting = None, None
    while at < n:
        stop = text.find("\n", at)
        stop = n if stop < 0 else stop
        start, at = at, stop + 1
        body = text[start:stop].strip(" \t\r\ufeff")
        if not body or body[0] in "#;!" or body.startswith("//"):
            continue
        m = SECTION.match(text, start, stop)
        if m:
            section, name, waiting = tuple(x.strip("\"' ") for x in m["name"].split(".")), None, None
            continue
        m = PAIR.match(text, start, stop)
        if m is None or text[start] in " \t" and waiting and not m["key"].strip().isidentifier():
            if waiting:  # the value stands on the next line
                p = start + len(text[start:stop]) - len(text[start:stop].lstrip())
                b = p + len(body)
                yield Leaf(waiting, p, b, b >= n)
            waiting = None
            continue
        waiting, key, p = None, m["key"].strip(), m.end()
        path = section + (tuple(key.split(".")) if key.lower() not in VALUES or name is None else (name,))
        if text.startswith(TRIPLE, p) or p < stop and text[p] in "\"'":
            leaf, end = quoted(text, p, stop, path)
        elif p < stop and text[p] in "{[":
            end = balanced(text, p, stop, open_from)
            yield from flow(text, p, end, path)
            leaf = None
        else:
            c = INNER_COMMENT.search(text, max(p - 1, start), stop)
            b = max(p, c.start() if c else stop)
            while text[b - 1 : b] == "\\" and b == stop and stop < n:  # the line goes on
                stop = text.find("\n", stop + 1)
                stop = n if stop < 0 else stop
                b, at = stop, stop + 1
            b = p + len(text[p:b].rstrip(" \t\r"))
            leaf, end = (Leaf(path, p, b, b >= n), b) if b > p else (None, b)
            if leaf is None:
                waiting = path
        if leaf:
            yield leaf
            if key.lower() in NAMES:
                name = text[leaf.start : leaf.end]
        if end > stop:
            at = text.find("\n", end)
            at = n if at < 0 else at + 1


FORMATS = {"json": lambda text: flow(text, 0, len(text), ()), "yaml": yaml, "yml": yaml} | dict.fromkeys(("ini", "cfg", "conf", "toml", "properties", "env"), pairs)


def leaves(text: str, ext: str) -> Iterator[Leaf]:
    """Values of a text by the format of its extension; nothing for other extensions."""
    return FORMATS[ext](text) if ext in FORMATS else iter(())
