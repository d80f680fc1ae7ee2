"""Token classes, bracket matching, memoised statements and panic-mode recovery shared by the grammars.

A file is cut into tokens by one compiled pattern and each token is replaced by one
character naming its class (identifiers, numbers and strings by class, keywords and
operators one by one). The parsers are recursive descent for statements and precedence
climbing for expressions over that class string. Validity depends on classes only, so
statements that have been accepted once are kept in a bounded memo shared by all files
of a Python worker and are accepted again by one dictionary look-up.
"""

from __future__ import annotations

import re
from itertools import accumulate

ID, NUM, STR, BAD, EOF = "i", "0", '"', "\x00", "\x01"
MEMO_LIMIT = 200_000
OPEN_CLOSE = {"(": ")", "[": "]", "{": "}"}


class Bad(Exception):
    """Syntax error at a class index."""

    def __init__(self, at: int, what: str):
        self.at, self.what = at, what


class Classes(dict):
    """token text -> class character, filled on first use and emptied when it gets large."""

    def __init__(self, words: list[str], classify):
        super().__init__()
        self.fixed = {w: (w if len(w) == 1 and not w.isalnum() and w != '"' else chr(0x100 + k)) for k, w in enumerate(words)}
        self.names = {v: k for k, v in self.fixed.items()} | {ID: "name", NUM: "number", STR: "string", BAD: "character", EOF: "end of file"}
        self.classify = classify

    def __missing__(self, tok: str) -> str:
        if len(self) > 100_000:
            self.clear()
        got = self.fixed.get(tok)
        if got is None:
            got = self.classify(tok)
        self[tok] = got
        return got


BRACKETS = re.compile(r"[()\[\]{}]")
LITERALS = re.compile(r'(?:-?[0"],)+')


class Func:
    """A function node: class indexes of its first token, its name and its end, and (Python) of its docstring."""

    __slots__ = ("start", "name", "head", "end", "doc", "kind", "owner")

    def __init__(self, start, name, head, end, doc=-1, kind="function", owner=-1):
        self.start, self.name, self.head, self.end, self.doc, self.kind, self.owner = start, name, head, end, doc, kind, owner

    def moved(self, by: int) -> "Func":
        return Func(self.start + by, self.name + by, self.head + by, self.end + by, self.doc + by if self.doc >= 0 else -1, self.kind, self.owner + by if self.owner >= 0 else -1)


class Places:
    """Offsets by class index, computed when asked for. Inserted tokens stand where the one before ended."""

    __slots__ = ("toks", "kept", "ends", "first", "size")

    def __init__(self, p: "Parser", kept: list[int], ends: list[int], first: bool):
        self.toks, self.kept, self.ends, self.first, self.size = p.toks, kept, ends, first, len(p.text)

    def __getitem__(self, at: int) -> int:
        if at >= len(self.kept):
            return self.size
        k = self.kept[at]
        if k >= 0:
            return self.ends[k] - len(self.toks[k]) if self.first else self.ends[k]
        while at and k < 0:
            at -= 1
            k = self.kept[at]
        return self.ends[k] if k >= 0 else 0


class Parser:
    classes: Classes
    pattern: re.Pattern
    sync = ";"
    by_line_break = 0  # statements ended by a line break, which classes do not show
    memo: dict

    def __init__(self, text: str):
        self.text = text
        self.toks = self.pattern.findall(text)
        self.funcs: list[Func] = []
        self.errors: list[tuple[int, str]] = []
        self.lex()
        self.s += EOF * 4
        self.i = 0
        self._pos = None
        self._match = None
        self._kept_once = None

    def lex(self) -> None:
        self.codes = list(map(self.classes.__getitem__, self.toks))
        self.s = "".join(self.codes)

    # positions -------------------------------------------------------------
    def kept(self) -> list[int]:
        return [k for k, c in enumerate(self.codes) if c]

    def kept_once(self) -> list[int]:
        if self._kept_once is None:
            self._kept_once = self.kept()
        return self._kept_once

    def positions(self) -> tuple["Places", "Places"]:
        """Start and end offsets in the text, by class index."""
        if self._pos is None:
            ends = list(accumulate(map(len, self.toks)))
            kept = self.kept_once()
            self._pos = (Places(self, kept, ends, True), Places(self, kept, ends, False))
        return self._pos

    def line(self, at: int) -> int:
        return self.text.count("\n", 0, self.positions()[0][at]) + 1

    @property
    def match(self) -> dict[int, int]:
        """Closing index of each bracket that has one."""
        if self._match is None:
            out, stack = {}, []
            for m in BRACKETS.finditer(self.s):
                c = m.group()
                if c in OPEN_CLOSE:
                    stack.append((c, m.start()))
                elif stack and OPEN_CLOSE[stack[-1][0]] == c:
                    out[stack.pop()[1]] = m.start()
                else:  # a bracket of the wrong kind: give up the open ones until it fits
                    keep = len(stack)
                    while keep and OPEN_CLOSE[stack[keep - 1][0]] != c:
                        keep -= 1
                    if keep:
                        out[stack[keep - 1][1]] = m.start()
                        del stack[keep - 1 :]
            self._match = out
        return self._match

    # primitives --------------------------------------------------------------
    def fail(self, what: str = "unexpected "):
        c = self.s[self.i]
        raise Bad(self.i, what + self.classes.names.get(c, c) if what.endswith(" ") else what)

    def need(self, c: str) -> None:
        if self.s[self.i] != c:
            self.fail(f"expected {self.classes.names.get(c, c)} before ")
        self.i += 1

    def take(self, c: str) -> bool:
        if self.s[self.i] == c:
            self.i += 1
            return True
        return False

    def attempt(self, f, *args) -> bool:
        at, n = self.i, len(self.funcs)
        try:
            return f(*args) is not False
        except Bad:
            self.i = at
            del self.funcs[n:]
            return False

    def remember(self, tag: str, end: int, f, *args) -> None:
        """f() parses from here; if it ends just behind `end`, later text of the same classes is taken at once."""
        at = self.i
        if end - at > 400:
            f(*args)
            return
        key = tag + self.s[at : end + 2]
        got = self.memo.get(key)
        if got is not None:
            self.i = end + 1
            for fn in got:
                self.funcs.append(fn.moved(at))
            return
        n, breaks, wrong = len(self.funcs), self.by_line_break, len(self.errors)
        f(*args)
        if self.i == end + 1 and breaks == self.by_line_break and wrong == len(self.errors):
            if len(self.memo) > MEMO_LIMIT:
                self.memo.clear()
            self.memo[key] = tuple(x.moved(-at) for x in self.funcs[n:])

    def group(self, tag: str, f, *args) -> None:
        """A bracketed group through the memo."""
        end = self.match.get(self.i)
        if end is None:
            f(*args)
        else:
            self.remember(tag, end, f, *args)

    def stretch(self, at: int) -> int | None:
        """Index of the semicolon that ends the statement at `at`, brackets skipped; None if a brace closes first."""
        s, find, match = self.s, STOP.search, self.match
        while True:
            m = find(s, at)
            if m is None:
                return None
            k, c = m.start(), m.group()
            if c == ";":
                return k
            if c in ")]}":
                return None
            e = match.get(k)
            if e is None:
                return None
            at = e + 1

    # statement lists with panic mode -------------------------------------------
    def statements(self, closers: str, one) -> None:
        while True:
            c = self.s[self.i]
            if c == EOF or c in closers:
                return
            at = self.i
            try:
                one()
                if self.i == at:
                    self.fail()
            except Bad as e:
                self.recover(e, at)

    def recover(self, e: Bad, at: int) -> None:
        """Keep the error and go on behind the next semicolon, or before the brace that closes this list."""
        self.errors.append((e.at, e.what))
        k, depth = max(e.at, at), 0
        s = self.s
        while True:
            c = s[k]
            if c == EOF:
                break
            if c == "{":
                depth += 1
            elif c == "}":
                if depth == 0:
                    break
                depth -= 1
                if depth == 0:
                    k += 1
                    break
            elif c == self.sync and depth == 0:
                k += 1
                break
            k += 1
        self.i = k if k > at else at + 1 if s[at] not in "}" + EOF else at

    def program(self) -> None:
        raise NotImplementedError

    def run(self) -> "Parser":
        try:
            self.program()
            while self.s[self.i] != EOF:  # a closing brace too many at the top
                self.errors.append((self.i, "unexpected " + self.classes.names.get(self.s[self.i], self.s[self.i])))
                self.i += 1
                self.program()
        except RecursionError:
            if not self.errors and self.unbalanced():
                self.errors.append((self.i, "unbalanced brackets"))
        return self

    def unbalanced(self) -> bool:
        """For text nested deeper than the parser follows: brackets alone decide."""
        opens = sum(self.s.count(c) for c in "([{")
        return len(self.match) != opens or opens != sum(self.s.count(c) for c in ")]}") or BAD in self.s


STOP = re.compile(r"[;()\[\]{}]")


def words(text: str) -> list[str]:
    return text.split()
