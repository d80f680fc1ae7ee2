"""Python 3."""

from __future__ import annotations

import re

from .core import BAD, EOF, ID, LITERALS, NUM, STR, Bad, Classes, Func, Parser, words

# fixed values: keywords and operators of Python
KEYWORDS = words("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield")
SOFT = words("match case type")
OPERATORS = words("** // >> << <= >= == != -> += -= *= /= //= %= @= &= |= ^= >>= <<= **= := ... + - * / % @ & | ^ ~ < > = : ; , . ( ) [ ] { }")
NUMBER = re.compile(r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:0(?:_?0)*|[1-9](?:_?[0-9])*)|(?:(?:[0-9](?:_?[0-9])*\.(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?|[0-9](?:_?[0-9])*[eE][+-]?[0-9](?:_?[0-9])*)|(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?(?:[eE][+-]?[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9]+)?)[jJ])\Z")
PREFIX = r"(?:[rRuUbBfF]|[rR][bBfF]|[bBfF][rR])?"
PATTERN = re.compile(
    r"[ \t\f]+|\\\r?\n|\r?\n[ \t\f]*|#[^\r\n]*"
    r"|" + PREFIX + r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|' + PREFIX + r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''"
    r"|" + PREFIX + r'"(?:[^"\\\n]|\\\r?[\s\S])*"(?!(?<!.)"")|' + PREFIX + r"'(?:[^'\\\n]|\\\r?[\s\S])*'"
    r"|[^\W\d]\w*|\.?[0-9](?:[\w.]|(?<=[eE])[+-](?=[0-9]))*"
    r"|\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|<=|>=|==|!=|->|:=|[+\-*/%@&|^]=|[\s\S]"
)
NEWLINE, INDENT, DEDENT, FSTR = "n", "I", "D", "F"


def classify(tok: str) -> str:
    c = tok[0]
    if c in "\r\n" and "\n" in tok:
        return NEWLINE
    if c in " \t\f#﻿" or tok[:1] == "\\" and "\n" in tok:
        return ""
    if c in "\"'" or tok[-1] in "\"'" and len(tok) > 1:
        if len(tok) < 2:
            return BAD
        if tok in ('""', "''") or tok[-1] in "\"'":
            head = tok[: min(tok.find('"') % 1_000_000, tok.find("'") % 1_000_000)].lower()
            return FSTR if "f" in head else "B" if "b" in head else STR
    if c.isalpha() or c == "_":
        return ID if tok.isidentifier() else BAD
    if c.isdigit() or c == "." and len(tok) > 1:
        return NUM if NUMBER.match(tok) else BAD
    return BAD


CLASSES = Classes(KEYWORDS + SOFT + OPERATORS, classify)
K = CLASSES.fixed
NAMES = ID + "".join(K[w] for w in SOFT)
STRINGS = STR + FSTR + "B"
CONST = NUM + K["True"] + K["False"] + K["None"] + K["..."]
BINARY = {K[o]: p for p, row in enumerate(["or", "and", "not", "in is < > <= >= == !=", "|", "^", "&", "<< >>", "+ -", "* / // % @"], 1) for o in row.split() if o != "not"}
AUG = "".join(K[o] for o in words("+= -= *= /= //= %= @= &= |= ^= >>= <<= **="))
ENDERS = ")]}:=;," + NEWLINE + EOF
FIELD = re.compile(r"\{\{|\}\}|[{}]")


class Python(Parser):
    classes, pattern, memo = CLASSES, PATTERN, {}
    sync = NEWLINE

    def lex(self) -> None:
        codes = list(map(self.classes.__getitem__, self.toks))
        toks, out, kept = self.toks, [], []
        depth, indents, fresh, last, width = 0, [0], True, NEWLINE, None
        add, keep = out.append, kept.append
        n = len(toks)
        if n and toks[0][:1] in " \t\f﻿":  # indentation of the first line
            lead = toks[0].lstrip("﻿")
            k = 1
            if lead == "" and n > 1 and toks[1][:1] in " \t\f":
                lead, k = toks[1], 2
            if lead and n > k and codes[k] not in ("", NEWLINE):
                add(INDENT)
                keep(-1)
                indents.append(len(lead))
        for k, c in enumerate(codes):
            if c == "":
                continue
            if c == NEWLINE:
                if depth:
                    continue
                if last != NEWLINE and last != INDENT and last != DEDENT:
                    add(NEWLINE)
                    keep(k)
                    last = NEWLINE
                fresh, width = True, toks[k]
                continue
            if fresh:
                fresh = False
                if width is not None:
                    w = width.rpartition("\n")[2].rpartition("\f")[2]
                    col = len(w.expandtabs(8)) if "\t" in w else len(w)
                    if col > indents[-1]:
                        indents.append(col)
                        add(INDENT)
                        keep(-1)
                    else:
                        while col < indents[-1]:
                            indents.pop()
                            add(DEDENT)
                            keep(-1)
                        if col != indents[-1]:
                            add(BAD)
                            keep(-1)
                            indents.append(col)
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth = depth - 1 if depth else 0
            if c == FSTR and not self.fstring(toks[k]):
                c = BAD
            add(c)
            keep(k)
            last = c
        if last != NEWLINE and out:
            add(NEWLINE)
            keep(-1)
        for _ in indents[1:]:
            add(DEDENT)
            keep(-1)
        self._kept = kept
        self.s = "".join(out)

    def kept(self) -> list[int]:
        return self._kept

    def fstring(self, tok: str) -> bool:
        """Braces of an f-string pair up and hold expressions."""
        got = self.memo.get("f" + tok) if len(tok) < 300 else None
        if got is None:
            q = min(tok.find('"') % 1_000_000, tok.find("'") % 1_000_000)
            size = 3 if tok[q : q + 3] in ('"""', "'''") else 1
            got = self.fields(tok[q + size : len(tok) - size], 0)
            if len(tok) < 300:
                self.memo["f" + tok] = got
        return got

    def fields(self, body: str, nested: int) -> bool:
        at = 0
        while True:
            m = FIELD.search(body, at)
            if m is None:
                return True
            if m.group() in ("{{", "}}") and not nested:
                at = m.end()
                continue
            if m.group() == "}":
                return False
            k, depth, quote = m.start() + 1, 1, ""
            start, spec = k, -1
            while k < len(body) and depth:
                c = body[k]
                if quote:
                    quote = "" if c == quote else quote
                elif c in "\"'":
                    quote = c
                elif c in "([{":
                    depth += 1
                elif c in ")]}":
                    depth -= 1
                elif depth == 1 and c == ":" and spec < 0:
                    spec = k
                k += 1
            if depth:
                return False
            expr = body[start : spec if spec >= 0 else k - 1]
            expr = re.sub(r"\s*=?\s*(?:![rsa])?\s*\Z", "", expr)
            p = Python("(" + expr + "\n)")
            try:
                p.need("(")
                p.yield_or_star()
                p.need(")")
                if p.s[p.i] != NEWLINE:
                    return False
            except Bad:
                return False
            if spec >= 0 and not self.fields(body[spec + 1 : k - 1], 1):
                return False
            at = k

    # statements ----------------------------------------------------------------------
    def program(self) -> None:
        while self.s[self.i] != EOF:
            at = self.i
            try:
                self.statement()
            except Bad as e:
                self.recover(e, at)

    def recover(self, e: Bad, at: int) -> None:
        """Keep the error; go on with the next line of the same or a smaller indentation."""
        self.errors.append((e.at, e.what))
        k = max(e.at, at)
        while self.s[k] not in NEWLINE + EOF:
            k += 1
        k += self.s[k] == NEWLINE
        while self.s[k] in INDENT + DEDENT:
            k += 1
        self.i = max(k, at + 1) if self.s[at] != EOF else at

    def statement(self) -> None:
        s = self.s
        c = s[self.i]
        f = DISPATCH.get(c)
        if f is not None:
            f(self)
        elif c == K["match"] and s[self.i + 1] not in ".=,)" + NEWLINE and self.attempt(self.match_):
            return
        else:
            self.simple_line()

    def simple_line(self) -> None:
        end = self.s.find(NEWLINE, self.i)
        if end < 0:
            self.line_body()
        else:
            self.remember("s", end, self.line_body)

    def line_body(self) -> None:
        while True:
            self.simple()
            if not self.take(";") or self.s[self.i] == NEWLINE:
                break
        self.need(NEWLINE)

    def block(self) -> int:
        """After a colon; returns the index of a docstring or -1."""
        s = self.s
        self.need(":")
        if not self.take(NEWLINE):
            doc = self.i if s[self.i] == STR and s[self.i + 1] in NEWLINE + ";" else -1
            if DISPATCH.get(s[self.i]) is not None:
                self.fail()
            self.simple_line()
            return doc
        if not self.take(INDENT):
            self.fail("expected an indented block before ")
        doc = self.i if s[self.i] == STR and s[self.i + 1] in NEWLINE + ";" + STR else -1
        while s[self.i] != DEDENT:
            if s[self.i] == EOF:
                self.fail()
            at = self.i
            try:
                self.statement()
            except Bad as e:
                self.recover(e, at)
                if s[self.i - 1] == DEDENT or s[self.i] == EOF:
                    return doc
        self.i += 1
        return doc

    def decorated(self) -> None:
        start = self.i
        while self.take("@"):
            self.named()
            self.need(NEWLINE)
        c = self.s[self.i]
        if c == K["async"] and self.s[self.i + 1] == K["def"] or c == K["def"]:
            self.def_(start)
        elif c == K["class"]:
            self.class_()
        else:
            self.fail()

    def async_(self) -> None:
        d = self.s[self.i + 1]
        if d == K["def"]:
            self.def_()
        elif d in (K["for"], K["with"]):
            self.i += 1
            self.for_() if d == K["for"] else self.with_()
        else:
            self.fail()

    def def_(self, start: int | None = None) -> None:
        start = self.i if start is None else start
        self.take(K["async"])
        self.i += 1
        name = self.i
        self.name()
        if self.s[self.i] == "[":
            self.type_params()
        if self.s[self.i] != "(":
            self.fail("expected ( before ")
        self.group("p", self.params)
        if self.take(K["->"]):
            self.yield_or_star()
        head = self.i
        owner, self.owner = self.owner, -1
        doc = self.block()
        self.owner = owner
        self.funcs.append(Func(start, name, head, self.i, doc, "method" if owner >= 0 else "function", owner))

    owner = -1

    def type_params(self) -> None:
        self.need("[")
        while self.s[self.i] != "]":
            if self.s[self.i] in "*" + K["**"]:
                self.i += 1
            self.name()
            if self.take(":"):
                self.test()
            if self.take("="):
                self.test()
            if self.s[self.i] != "]":
                self.need(",")
        self.i += 1

    def name(self) -> None:
        if self.s[self.i] not in NAMES:
            self.fail()
        self.i += 1

    def params(self, close: str = ")", typed: bool = True) -> None:
        s = self.s
        if typed:
            self.need("(")
        default = star = False
        while s[self.i] != close:
            if self.take("/"):
                if s[self.i - 2] == "(":
                    self.fail()
            elif self.take("*"):
                if star:
                    self.fail()
                star = True
                if s[self.i] != ",":
                    self.name()
                    if typed and self.take(":"):
                        self.take("*")
                        self.test()
                elif s[self.i + 1] == close:
                    self.fail()
            elif self.take(K["**"]):
                self.name()
                if typed and self.take(":"):
                    self.test()
                self.take(",")
                if s[self.i] != close:
                    self.fail()
                break
            else:
                self.name()
                if typed and self.take(":"):
                    self.test()
                if self.take("="):
                    self.test()
                    default = True
                elif default and not star:
                    self.fail("parameter without a default before ")
            if s[self.i] != close:
                self.need(",")
        self.i += typed

    def class_(self) -> None:
        self.i += 1
        name = self.i
        self.name()
        if self.s[self.i] == "[":
            self.type_params()
        if self.s[self.i] == "(":
            self.args()
        owner, self.owner = self.owner, name
        self.block()
        self.owner = owner

    def if_(self) -> None:
        self.i += 1
        self.header()
        self.block()
        while self.take(K["elif"]):
            self.header()
            self.block()
        if self.take(K["else"]):
            self.block()

    def header(self) -> None:
        """A condition up to the colon that ends the line."""
        end = self.s.find(NEWLINE, self.i)
        if end > 0 and self.s[end - 1] == ":" and end - 2 >= self.i:
            self.remember("h", end - 2, self.named)
        else:
            self.named()

    def while_(self) -> None:
        self.i += 1
        self.header()
        self.block()
        if self.take(K["else"]):
            self.block()

    def for_(self) -> None:
        self.i += 1
        end = self.s.find(NEWLINE, self.i)
        if end > 0 and self.s[end - 1] == ":" and end - 2 >= self.i:
            self.remember("r", end - 2, self.for_head)
        else:
            self.for_head()
        self.block()
        if self.take(K["else"]):
            self.block()

    def for_head(self) -> None:
        self.targets()
        self.need(K["in"])
        self.stars()

    def targets(self) -> None:
        self.target()
        while self.take(","):
            if self.s[self.i] == K["in"]:
                break
            self.target()

    def target(self) -> None:
        self.take("*")
        self.unary_power()

    def with_(self) -> None:
        self.i += 1
        at = self.i
        if self.s[at] == "(" and self.attempt(self.with_paren):
            self.block()
            return
        self.with_items()
        self.block()

    def with_paren(self):
        self.need("(")
        self.with_items()
        self.need(")")
        return self.s[self.i] == ":" or self.fail()

    def with_items(self) -> None:
        while True:
            self.test()
            if self.take(K["as"]):
                self.target()
            if not self.take(",") or self.s[self.i] == ")":
                break

    def try_(self) -> None:
        s = self.s
        self.i += 1
        self.block()
        seen = False
        while self.take(K["except"]):
            seen = True
            self.take("*")
            if s[self.i] != ":":
                self.test()
                while self.take(","):
                    self.test()
                if self.take(K["as"]):
                    self.name()
            self.block()
        if seen and self.take(K["else"]):
            self.block()
        if self.take(K["finally"]):
            seen = True
            self.block()
        if not seen:
            self.fail("expected except or finally before ")

    def match_(self):
        self.i += 1
        self.stars()
        self.need(":")
        self.need(NEWLINE)
        self.need(INDENT)
        while not self.take(DEDENT):
            self.need(K["case"])
            self.case_pattern()
            if self.take(K["if"]):
                self.named()
            self.block()
        return True

    def case_pattern(self) -> None:
        s = self.s
        while True:
            self.take("*")
            self.binary(5)
            if self.take(K["as"]):
                self.name()
            if not self.take(",") or s[self.i] in ":" + K["if"]:
                return

    def simple(self) -> None:
        s = self.s
        c = s[self.i]
        f = SIMPLE.get(c)
        if f is not None:
            f(self)
            return
        if c == K["type"] and s[self.i + 1] in NAMES:
            self.i += 2
            if s[self.i] == "[":
                self.type_params()
            self.need("=")
            self.test()
            return
        at = self.i
        self.yield_or_star()
        c = s[self.i]
        if c == ":":
            if not self.assignable(at, self.i, False):
                self.fail()
            self.i += 1
            self.test()
            if self.take("="):
                self.yield_or_star()
        elif c in AUG:
            if not self.assignable(at, self.i, False):
                self.fail()
            self.i += 1
            self.yield_or_star()
        else:
            while s[self.i] == "=":
                if not self.assignable(at, self.i, True):
                    self.fail()
                self.i += 1
                at = self.i
                self.yield_or_star()

    def assignable(self, at: int, end: int, many: bool) -> bool:
        """Names, attributes, subscripts, or lists of them."""
        last = self.s[end - 1]
        if last in NAMES + "]" or last == ")" and self.s[at] in "([":
            return not any(c in "+-/%~" or c in AUG or c == K["if"] for c in self.top(at, end))
        return last == "," and many

    def top(self, at: int, end: int):
        match = self.match
        while at < end:
            yield self.s[at]
            at = match.get(at, at) + 1

    def keyword_only(self) -> None:
        self.i += 1

    def return_(self) -> None:
        self.i += 1
        if self.s[self.i] not in NEWLINE + ";":
            self.stars()

    def raise_(self) -> None:
        self.i += 1
        if self.s[self.i] not in NEWLINE + ";":
            self.test()
            if self.take(K["from"]):
                self.test()

    def names(self) -> None:
        self.i += 1
        self.name()
        while self.take(","):
            self.name()

    def del_(self) -> None:
        self.i += 1
        self.stars()

    def assert_(self) -> None:
        self.i += 1
        self.test()
        if self.take(","):
            self.test()

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def import_(self) -> None:
        self.i += 1
        while True:
            self.dotted()
            if self.take(K["as"]):
                self.name()
            if not self.take(","):
                break

    def from_(self) -> None:
        s = self.s
        self.i += 1
        dots = 0
        while s[self.i] in "." + K["..."]:
            self.i += 1
            dots += 1
        if not dots or s[self.i] != K["import"]:
            self.dotted()
        self.need(K["import"])
        if self.take("*"):
            return
        paren = self.take("(")
        while True:
            self.name()
            if self.take(K["as"]):
                self.name()
            if not self.take(",") or paren and s[self.i] == ")":
                break
        if paren:
            self.need(")")

    # expressions ---------------------------------------------------------------------
    def yield_or_star(self) -> None:
        if self.take(K["yield"]):
            if self.take(K["from"]):
                self.test()
            elif self.s[self.i] not in ENDERS:
                self.stars()
            return
        self.stars()

    def stars(self) -> None:
        s = self.s
        self.star()
        while self.take(","):
            if s[self.i] in ENDERS or s[self.i] in AUG or s[self.i] == K["in"]:
                break
            self.star()

    def star(self) -> None:
        if self.take("*"):
            self.binary(5)
        else:
            self.named()

    def named(self) -> None:
        if self.s[self.i] in NAMES and self.s[self.i + 1] == K[":="]:
            self.i += 2
        self.test()

    def test(self) -> None:
        if self.s[self.i] == K["lambda"]:
            self.i += 1
            self.params(":", False)
            self.need(":")
            self.test()
            return
        self.binary(1)
        if self.take(K["if"]):
            self.binary(1)
            self.need(K["else"])
            self.test()

    def binary(self, least: int) -> None:
        s = self.s
        if s[self.i] == K["not"]:
            if least > 3:
                self.fail()
            self.i += 1
            self.binary(3)
        else:
            self.unary_power()
        while True:
            c = s[self.i]
            if c == K["not"] and s[self.i + 1] == K["in"] and least <= 4:
                self.i += 2
                self.binary(5)
                continue
            p = BINARY.get(c)
            if p is None or p < least:
                return
            self.i += 1
            if c == K["is"]:
                self.take(K["not"])
            self.binary(p + 1)

    def unary_power(self) -> None:
        s = self.s
        while s[self.i] in "+-~":
            self.i += 1
        self.take(K["await"])
        self.postfix()
        if self.take(K["**"]):
            self.unary_power()

    def postfix(self) -> None:
        s = self.s
        c = s[self.i]
        if c in NAMES or c in CONST:
            self.i += 1
        elif c in STRINGS:
            self.i += 1
            while s[self.i] in STRINGS:
                if (s[self.i] == "B") != (s[self.i - 1] == "B"):
                    self.fail()
                self.i += 1
        elif c == "(":
            self.i += 1
            if not self.take(")"):
                if s[self.i] == K["yield"]:
                    self.yield_or_star()
                else:
                    self.display(")")
                self.need(")")
        elif c == "[":
            self.i += 1
            if not self.take("]"):
                self.display("]")
                self.need("]")
        elif c == "{":
            self.braces()
        else:
            self.fail()
        while True:
            c = s[self.i]
            if c == ".":
                self.i += 1
                self.name()
            elif c == "(":
                self.group("a", self.args)
            elif c == "[":
                self.i += 1
                self.subscript()
                while self.take(","):
                    if s[self.i] == "]":
                        break
                    self.subscript()
                self.need("]")
            else:
                return

    def subscript(self) -> None:
        s = self.s
        if s[self.i] != ":":
            self.star()
        if self.take(":"):
            if s[self.i] not in ":],":
                self.test()
            if self.take(":") and s[self.i] not in "],":
                self.test()

    def display(self, close: str) -> None:
        s = self.s
        m = LITERALS.match(s, self.i)
        if m:
            self.i = m.end()
            if s[self.i] == close:
                return
        self.star()
        if s[self.i] in K["for"] + K["async"] and not m:
            self.comprehension()
            return
        while self.take(","):
            m = LITERALS.match(s, self.i)
            if m:
                self.i = m.end()
            if s[self.i] == close:
                return
            self.star()

    def comprehension(self) -> None:
        s = self.s
        while s[self.i] in K["for"] + K["async"] + K["if"]:
            if self.take(K["if"]):
                self.comp_condition()
                continue
            self.take(K["async"])
            self.need(K["for"])
            self.targets()
            self.need(K["in"])
            self.comp_condition()

    def comp_condition(self) -> None:
        if self.s[self.i] in NAMES and self.s[self.i + 1] == K[":="]:
            self.i += 2
        if self.s[self.i] == K["lambda"]:
            self.test()
            return
        self.binary(1)

    def braces(self) -> None:
        s = self.s
        self.need("{")
        if self.take("}"):
            return
        first = True
        while True:
            if self.take(K["**"]):
                self.binary(5)
            else:
                self.star()
                if self.take(":"):
                    self.test()
            if first and s[self.i] in K["for"] + K["async"]:
                self.comprehension()
                break
            first = False
            if not self.take(",") or s[self.i] == "}":
                break
        self.need("}")

    def args(self) -> None:
        s = self.s
        self.need("(")
        keyword = False
        while s[self.i] != ")":
            if self.take(K["**"]):
                self.test()
                keyword = True
            elif self.take("*"):
                self.test()
            elif s[self.i] in NAMES and s[self.i + 1] == "=":
                self.i += 2
                self.test()
                keyword = True
            else:
                if keyword:
                    self.fail("positional argument after keyword argument before ")
                self.named()
                if s[self.i] in K["for"] + K["async"]:
                    self.comprehension()
            if s[self.i] != ")":
                self.need(",")
        self.i += 1


DISPATCH = {K[w]: f for w, f in {"def": Python.def_, "class": Python.class_, "if": Python.if_, "while": Python.while_, "for": Python.for_, "with": Python.with_, "try": Python.try_, "async": Python.async_, "@": Python.decorated}.items()}
SIMPLE = {K[w]: f for w, f in {"pass": Python.keyword_only, "break": Python.keyword_only, "continue": Python.keyword_only, "return": Python.return_, "raise": Python.raise_, "global": Python.names, "nonlocal": Python.names, "del": Python.del_, "assert": Python.assert_, "import": Python.import_, "from": Python.from_}.items()}
