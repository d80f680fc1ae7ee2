"""JavaScript (script or module) and TypeScript."""

from __future__ import annotations

import re

from .core import BAD, EOF, ID, LITERALS, NUM, STR, Bad, Classes, Func, Parser, words

# fixed values: reserved words, contextual words and operators of ECMAScript and TypeScript
RESERVED = words("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum")
CONTEXTUAL = words("async await let static yield of get set as from type interface namespace module declare abstract readonly keyof infer is satisfies implements public private protected override constructor asserts unique accessor")
OPERATORS = words("=> ?. ?? && || == === != !== <= >= << ++ -- ** ... += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= < > = + - * / % & | ^ ! ~ ? : ; , . ( ) [ ] { } @ #")
NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:[0-9](?:_?[0-9])*)n|(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?)\Z")
SIMPLE_EXPR = re.compile(r"\$\{([^{}`]*)\}")
BEFORE_REGEX = r"(?:(?<=[=(,:\[!&|?{};>+*~^\n\t-])|(?<=[=(,:\[!&|?{};>+*~^-] )|(?<=return )|(?<=typeof )|(?<=\n  )|\A)"
PATTERN = re.compile(
    r"[ \t\r\v\f ﻿]+|\n\s*|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|/\*"
    r"|" + BEFORE_REGEX + r"/(?![/*])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*"
    r"|[^\W\d][\w$]*|\$[\w$]*|[0-9.]*[0-9](?:[\w.]|(?<=[eE])[+-](?=[0-9]))*"
    r"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\""
    r"|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^{}`]*\})*`"
    r"|>>>=|>>=|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|\.\.\.|=>|\?\.(?![0-9])|\?\?|&&|\|\||==|!=|<=|>=|<<|\+\+|--|\*\*|[+\-*/%&|^]=|[\s\S]"
)


def classify(tok: str) -> str:
    c = tok[0]
    if c in " \t\r\v\f\n ﻿" or tok.startswith("//"):
        return ""
    if tok.startswith("/*"):
        return "" if len(tok) > 3 else BAD
    if c.isalpha() or c in "_$":
        return ID
    if c.isdigit() or c == "." and len(tok) > 1:
        return NUM if NUMBER.match(tok) else BAD
    if c in "'\"" and len(tok) > 1:
        return STR
    if c == "`" and len(tok) > 1:
        return "T"
    if c == "/" and len(tok) > 2:
        return "R"
    return BAD


CLASSES = Classes(RESERVED + CONTEXTUAL + OPERATORS, classify)
K = CLASSES.fixed
NAMES = "".join(K[w] for w in CONTEXTUAL) + ID
WORDS = NAMES + "".join(K[w] for w in RESERVED)
ATOMS = NAMES + NUM + STR + "R" + "".join(K[w] for w in words("this super null true false"))
BINARY = {K[o]: p for p, row in enumerate(["??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in", "<<", "+ -", "* / %", "**"], 1) for o in row.split()}
ASSIGN = "".join(K[o] for o in words("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??="))
PREFIX = "+-!~" + "".join(K[w] for w in words("++ -- typeof void delete await"))
MODS = "".join(K[w] for w in words("public private protected static readonly override abstract declare async accessor"))
ARROW, DOTS, QDOT = K["=>"], K["..."], K["?."]
FUNCTION, CLASS, NEW, ASYNC, IN, OF, AS, SAT = (K[w] for w in words("function class new async in of as satisfies"))
INCDEC = K["++"] + K["--"]


class Ecma(Parser):
    classes, pattern, ts = CLASSES, PATTERN, False

    def lex(self) -> None:
        if "\n#!" in "\n" + self.text[:2]:
            self.toks = self.pattern.findall("//" + self.text[2:])
            self.toks[0] = "//" + self.toks[0][2:]
        codes = list(map(self.classes.__getitem__, self.toks))
        if "`" in self.toks:
            codes = self.slow_templates()
        elif "T" in codes:
            for k, c in enumerate(codes):
                if c == "T":
                    codes[k] = self.template(self.toks[k])
        self.codes = codes
        self.s = "".join(codes)

    def template(self, tok: str) -> str:
        if "${" in tok:
            for e in SIMPLE_EXPR.findall(tok):
                if not self.expression_ok(e):
                    return BAD
        return STR

    def expression_ok(self, e: str) -> bool:
        key = "${" + e
        got = self.memo.get(key)
        if got is None:
            p = type(self)(e)
            try:
                p.expr()
                got = p.s[p.i] == EOF
            except Bad:
                got = False
            if len(e) < 200:
                self.memo[key] = got
        return got

    def slow_templates(self) -> list[str]:
        """Templates with braces or templates inside: found by matching, their expressions parsed on their own."""
        text, out, at, toks = self.text, [], 0, []
        while at < len(text):
            if text[at] == "`":
                end, ok = self.template_end(at)
                toks.append(text[at:end])
                out.append(STR if ok else BAD)
                at = end
                continue
            m = self.pattern.match(text, at)
            tok = m.group()
            toks.append(tok)
            c = self.classes[tok]
            out.append(self.template(tok) if c == "T" else c)
            at = m.end()
        self.toks = toks
        return out

    def template_end(self, at: int) -> tuple[int, bool]:
        text, k, n, ok = self.text, at + 1, len(self.text), True
        while k < n:
            c = text[k]
            if c == "\\":
                k += 2
            elif c == "`":
                return k + 1, ok
            elif c == "$" and text[k + 1 : k + 2] == "{":
                b, depth = k + 2, 1
                k = b
                while k < n and depth:
                    if text[k] == "`":
                        k, inner = self.template_end(k)
                        ok = ok and inner
                        continue
                    tok = self.pattern.match(text, k).group()
                    depth += (tok == "{") - (tok == "}")
                    k += len(tok)
                ok = ok and depth == 0 and self.expression_ok(text[b : k - 1])
            else:
                k += 1
        return n, False

    def newline_before(self, at: int) -> bool:
        starts, ends = self.positions()
        return "\n" in self.text[ends[at - 1] if at else 0 : starts[at]]

    def semi(self) -> None:
        c = self.s[self.i]
        if c == ";":
            self.i += 1
        elif c != "}" and c != EOF:
            if not self.newline_before(self.i):
                self.fail()
            self.by_line_break += 1

    # statements ------------------------------------------------------------
    def program(self) -> None:
        self.statements("}", self.statement)

    def block(self) -> None:
        self.need("{")
        self.statements("}", self.statement)
        self.need("}")

    def paren(self) -> None:
        self.need("(")
        self.expr()
        self.need(")")

    def statement(self) -> None:
        c = self.s[self.i]
        f = DISPATCH.get(c)
        if f is not None:
            f(self)
        elif c == ";":
            self.i += 1
        elif c == "{":
            self.block()
        else:
            self.plain()

    def plain(self) -> None:
        s, i = self.s, self.i
        c, d = s[i], s[i + 1]
        if c == ASYNC and d == FUNCTION:
            self.function(i, True)
            return
        if self.ts and c in NAMES:
            if c in TS_DECL and self.attempt(self.ts_declaration):
                return
        if c in NAMES and d == ":":
            self.i += 2
            self.statement()
            return
        if c == K["let"] and (d in NAMES or d in "[{"):
            self.var()
            return
        end = self.stretch(i)
        if end is None:
            self.expr()
            self.semi()
        else:
            self.remember("s", end, self.expression_statement)

    def expression_statement(self) -> None:
        self.expr()
        self.semi()

    def var(self) -> None:
        end = self.stretch(self.i)
        if end is None:
            self.var_body()
        else:
            self.remember("v", end, self.var_body)

    def var_body(self, in_for: bool = False) -> None:
        start = self.i if not (self.i and self.s[self.i - 1] in EXPORTS) else self.exported(self.i)
        const = self.s[self.i] == K["const"]
        if const and self.ts and self.s[self.i + 1] == K["enum"]:
            self.i += 1
            self.enum()
            return
        self.i += 1
        while True:
            name = self.i
            simple = self.s[name] in NAMES
            self.binding()
            if self.ts:
                self.take("!")
                if self.take(":"):
                    self.type()
            if self.take("="):
                n, at = len(self.funcs), self.i
                self.assignment(not in_for)
                if simple and not in_for:
                    self.assigned(start, name, at, n)
            elif in_for and self.s[self.i] in (OF, IN):
                return
            elif not in_for and (const and not self.ts or not simple) and not self.ambient:
                self.fail("expected = before ")
            if not self.take(","):
                break
            start = self.i
        if not in_for:
            self.semi()

    ambient = False

    def exported(self, at: int) -> int:
        while at and self.s[at - 1] in EXPORTS:
            at -= 1
        return at

    def assigned(self, start: int, name: int, at: int, n: int) -> None:
        """A function that is the whole value of a name belongs to that name."""
        s = self.s
        arrow = s[at] == FUNCTION or s[at] == ASYNC and s[at + 1] == FUNCTION or self.last_arrow == (at, self.i)
        if arrow and (self.last_arrow == (at, self.i) or self.last_function == (at, self.i)):
            self.funcs.append(Func(start, name, self.head_end, self.i, kind="function"))

    last_arrow = last_function = (-1, -1)
    head_end = 0

    def binding(self) -> None:
        c = self.s[self.i]
        if c in NAMES:
            self.i += 1
        elif c == "[":
            self.i += 1
            while self.s[self.i] != "]":
                if self.take(","):
                    continue
                self.take(DOTS)
                self.binding()
                if self.take("="):
                    self.assignment()
                if self.s[self.i] != "]":
                    self.need(",")
            self.i += 1
        elif c == "{":
            self.i += 1
            while self.s[self.i] != "}":
                if self.take(DOTS):
                    self.binding()
                else:
                    short = self.s[self.i] in NAMES
                    self.property_name()
                    if self.take(":"):
                        self.binding()
                    elif not short:
                        self.fail()
                    if self.take("="):
                        self.assignment()
                if self.s[self.i] != "}":
                    self.need(",")
            self.i += 1
        else:
            self.fail()

    def property_name(self) -> None:
        c = self.s[self.i]
        if c == "[":
            self.i += 1
            self.assignment()
            self.need("]")
        elif c in WORDS or c == NUM or c == STR:
            self.i += 1
        elif c == "#" and self.s[self.i + 1] in WORDS:
            self.i += 2
        else:
            self.fail()

    def params(self) -> None:
        self.need("(")
        while self.s[self.i] != ")":
            while self.s[self.i] == "@":
                self.decorator()
            self.take(DOTS)
            if self.ts:
                while self.s[self.i] in MODS and (self.s[self.i + 1] in NAMES or self.s[self.i + 1] in "[{"):
                    self.i += 1
            if self.ts and self.s[self.i] == K["this"]:
                self.i += 1
            else:
                self.binding()
            if self.ts:
                self.take("?")
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.assignment()
            if self.s[self.i] != ")":
                self.need(",")
        self.i += 1

    def signature(self) -> None:
        if self.ts and self.s[self.i] == "<":
            self.type_params()
        if self.s[self.i] != "(":
            self.fail("expected ( before ")
        self.group("p" if not self.ts else "P", self.params)
        if self.ts and self.take(":"):
            self.return_type()

    def function(self, start: int | None = None, statement: bool = True) -> None:
        at = self.i
        self.take(ASYNC)
        self.need(FUNCTION)
        self.take("*")
        name = -1
        if self.s[self.i] in NAMES:
            name = self.i
            self.i += 1
        elif statement and not (self.i and self.default_export):
            self.fail("expected a function name before ")
        self.signature()
        head = self.i
        if self.ts and statement and self.s[self.i] != "{":
            self.semi()
            return
        self.block()
        if name >= 0:
            self.funcs.append(Func(self.exported(at if start is None else start), name, head, self.i))
        self.last_function, self.head_end = (at, self.i), head

    default_export = False

    def klass(self, statement: bool = True) -> None:
        self.need(CLASS)
        owner = -1
        if self.s[self.i] in NAMES and self.s[self.i] not in (K["implements"],):
            owner = self.i
            self.i += 1
        elif statement and not self.default_export:
            self.fail("expected a class name before ")
        if self.ts and self.s[self.i] == "<":
            self.type_params()
        if self.take(K["extends"]):
            self.postfix_expr()
            if self.ts and self.s[self.i] == "<":
                self.type_args()
        if self.ts and self.take(K["implements"]):
            self.type()
            while self.take(","):
                self.type()
        self.need("{")
        self.owner, before = owner, getattr(self, "owner", -1)
        self.statements("}", self.member)
        self.owner = before
        self.need("}")

    def decorator(self) -> None:
        self.need("@")
        self.postfix_expr()

    def member(self) -> None:
        s, start = self.s, self.i
        if self.take(";"):
            return
        while s[self.i] == "@":
            self.decorator()
        if s[self.i] == K["static"] and s[self.i + 1] == "{":
            self.i += 1
            self.block()
            return
        while s[self.i] in MODS and s[self.i + 1] not in "(=;:?!}<" + EOF and (self.ts or s[self.i] in (K["static"], ASYNC, K["accessor"])):
            self.i += 1
        self.take("*")
        if s[self.i] in (K["get"], K["set"]) and (s[self.i + 1] in WORDS or s[self.i + 1] in "[#" + STR + NUM):
            self.i += 1
        name = self.i
        if self.ts and s[self.i] == "[" and s[self.i + 1] in NAMES and s[self.i + 2] == ":":
            self.i += 3
            self.type()
            self.need("]")
            self.need(":")
            self.type()
            self.semi()
            return
        self.property_name()
        if s[name] == "#":
            name += 1
        if self.ts:
            self.take("?") or self.take("!")
        if s[self.i] == "(" or self.ts and s[self.i] == "<":
            self.signature()
            head = self.i
            if self.ts and s[self.i] != "{":
                self.semi()
                return
            self.block()
            if s[name] != "[":
                self.funcs.append(Func(start, name, head, self.i, kind="method", owner=self.owner))
            return
        if self.ts and self.take(":"):
            self.type()
        if self.take("="):
            n, at = len(self.funcs), self.i
            self.assignment()
            self.assigned(start, name, at, n)
        self.semi()

    def if_(self) -> None:
        self.i += 1
        self.group("c", self.paren)
        self.statement()
        if self.take(K["else"]):
            self.statement()

    def while_(self) -> None:
        self.i += 1
        self.group("c", self.paren)
        self.statement()

    def do(self) -> None:
        self.i += 1
        self.statement()
        self.need(K["while"])
        self.group("c", self.paren)
        self.take(";")

    def for_(self) -> None:
        self.i += 1
        self.take(K["await"])
        if self.s[self.i] != "(":
            self.fail()
        self.group("f", self.for_head)
        self.statement()

    def for_head(self) -> None:
        self.need("(")
        c = self.s[self.i]
        if c in (K["var"], K["const"]) or c == K["let"] and self.s[self.i + 1] not in (IN, OF):
            self.var_body(True)
        elif c != ";":
            self.expr(False)
        if self.take(OF):
            self.assignment()
        elif self.take(IN):
            self.expr()
        else:
            self.need(";")
            if self.s[self.i] != ";":
                self.expr()
            self.need(";")
            if self.s[self.i] != ")":
                self.expr()
        self.need(")")

    def switch(self) -> None:
        self.i += 1
        self.group("c", self.paren)
        self.need("{")
        while self.s[self.i] != "}":
            if self.take(K["case"]):
                self.expr()
            else:
                self.need(K["default"])
            self.need(":")
            self.statements("}" + K["case"] + K["default"], self.statement)
        self.i += 1

    def try_(self) -> None:
        self.i += 1
        self.block()
        seen = False
        if self.take(K["catch"]):
            seen = True
            if self.take("("):
                self.binding()
                if self.ts and self.take(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.take(K["finally"]):
            seen = True
            self.block()
        if not seen:
            self.fail("expected catch or finally before ")

    def jump(self) -> None:
        c = self.s[self.i]
        self.i += 1
        if c == K["return"] or c == K["throw"]:
            end = self.stretch(self.i)
            if self.s[self.i] not in ";}" + EOF and not (end is None and self.newline_before(self.i)):
                if end is not None:
                    self.remember("s", end, self.expression_statement)
                    return
                self.expr()
            elif c == K["throw"]:
                self.fail()
        elif self.s[self.i] in NAMES and not self.newline_before(self.i):
            self.i += 1
        self.semi()

    def import_(self) -> None:
        s = self.s
        if s[self.i + 1] in "(.":
            self.expression_statement()
            return
        self.i += 1
        if self.ts and s[self.i] == K["type"] and s[self.i + 1] not in (K["from"], ",", "="):
            self.i += 1
        if self.take(STR):
            self.attributes()
            self.semi()
            return
        if s[self.i] in NAMES:
            self.i += 1
            if self.ts and self.take("="):
                self.expr()
                self.semi()
                return
            if s[self.i] != K["from"]:
                self.need(",")
        if self.take("*"):
            self.need(AS)
            self.names()
        elif s[self.i] == "{":
            self.specifiers()
        self.need(K["from"])
        self.need(STR)
        self.attributes()
        self.semi()

    def attributes(self) -> None:
        if self.s[self.i] == K["with"]:
            self.i += 1
            self.object()

    def names(self) -> None:
        if self.s[self.i] not in NAMES:
            self.fail()
        self.i += 1

    def specifiers(self) -> None:
        self.need("{")
        while self.s[self.i] != "}":
            if self.ts and self.s[self.i] == K["type"] and self.s[self.i + 1] in WORDS and self.s[self.i + 1] != AS:
                self.i += 1
            if self.s[self.i] not in WORDS + STR:
                self.fail()
            self.i += 1
            if self.take(AS):
                if self.s[self.i] not in WORDS + STR:
                    self.fail()
                self.i += 1
            if self.s[self.i] != "}":
                self.need(",")
        self.i += 1

    def export(self) -> None:
        s = self.s
        self.i += 1
        c = s[self.i]
        if c == K["default"]:
            self.i += 1
            c = s[self.i]
            if c == FUNCTION or c == ASYNC and s[self.i + 1] == FUNCTION or c == CLASS or self.ts and c == K["abstract"] and s[self.i + 1] == CLASS:
                self.default_export = True
                try:
                    if c == K["abstract"]:
                        self.i += 1
                    self.klass() if s[self.i] == CLASS else self.function()
                finally:
                    self.default_export = False
            elif self.ts and c == K["interface"]:
                self.ts_declaration()
            else:
                self.assignment()
                self.semi()
        elif c == "*":
            self.i += 1
            if self.take(AS):
                self.i += 1
            self.need(K["from"])
            self.need(STR)
            self.semi()
        elif c == "{" or self.ts and c == K["type"] and s[self.i + 1] == "{":
            self.i += c != "{"
            self.specifiers()
            if self.take(K["from"]):
                self.need(STR)
            self.semi()
        elif self.ts and c == "=":
            self.i += 1
            self.expr()
            self.semi()
        elif c == FUNCTION or c == ASYNC and s[self.i + 1] == FUNCTION:
            self.function()
        elif c == CLASS or c == "@":
            self.statement()
        elif c in (K["const"], K["var"], K["let"]):
            self.var()
        elif self.ts and (c in TS_DECL or c == K["enum"]):
            self.enum() if c == K["enum"] else self.ts_declaration()
        else:
            self.fail()

    def enum(self) -> None:
        if not self.ts:
            self.fail()
        self.i += 1
        self.names()
        self.need("{")
        while self.s[self.i] != "}":
            self.property_name()
            if self.take("="):
                self.assignment()
            if self.s[self.i] != "}":
                self.need(",")
        self.i += 1

    def ts_declaration(self):
        s, c = self.s, self.s[self.i]
        if c == K["declare"]:
            self.i += 1
            self.ambient = True
            try:
                d = s[self.i]
                if d in NAMES and d not in TS_DECL + K["let"]:
                    return False if not (d == ID and s[self.i + 1] == "{") else (setattr(self, "i", self.i + 1), self.block())[1]
                self.statement()
            finally:
                self.ambient = False
            return None
        if c == K["abstract"]:
            if s[self.i + 1] != CLASS:
                self.fail()
            self.i += 1
            self.klass()
            return None
        self.i += 1
        if c in (K["namespace"], K["module"]):
            if not self.take(STR):
                self.names()
                while self.take("."):
                    self.names()
            self.block()
            return None
        self.names()
        if s[self.i] == "<":
            self.type_params()
        if c == K["type"]:
            self.need("=")
            self.type()
            self.semi()
            return None
        if self.take(K["extends"]):
            self.type()
            while self.take(","):
                self.type()
        self.type_members()
        return None

    # types -------------------------------------------------------------------
    def type_members(self) -> None:
        s = self.s
        self.need("{")
        while s[self.i] != "}":
            if s[self.i] in "+-" and s[self.i + 1] == K["readonly"]:
                self.i += 2
            while s[self.i] in MODS + K["get"] + K["set"] and s[self.i + 1] not in "(:?<;,}":
                self.i += 1
            if s[self.i] == K["new"] and s[self.i + 1] == "(":
                self.i += 1
            if s[self.i] == "[" and s[self.i + 1] in NAMES and s[self.i + 2] in (":", IN):
                self.i += 3
                self.type()
                if self.take(AS):
                    self.type()
                self.need("]")
                if s[self.i] in "+-":
                    self.i += 1
            elif s[self.i] not in "(<":
                self.property_name()
            self.take("?")
            if s[self.i] in "(<":
                self.signature()
            elif self.take(":"):
                self.type()
            if s[self.i] in ";,":
                self.i += 1
            elif s[self.i] != "}" and not self.newline_before(self.i):
                self.fail()
        self.i += 1

    def return_type(self) -> None:
        s = self.s
        if s[self.i] == K["asserts"] and s[self.i + 1] in NAMES + K["this"]:
            self.i += 2
            if self.take(K["is"]):
                self.type()
        elif s[self.i] in NAMES + K["this"] and s[self.i + 1] == K["is"]:
            self.i += 2
            self.type()
        else:
            self.type()

    def type(self) -> None:
        s = self.s
        if s[self.i] == "<" or s[self.i] == "(" and self.function_type() or s[self.i] == NEW:
            self.take(NEW)
            if s[self.i] == "<":
                self.type_params()
            self.params()
            self.need(ARROW)
            self.return_type()
            return
        if s[self.i] in "|&":
            self.i += 1
        while True:
            self.type_primary()
            if s[self.i] in "|&":
                self.i += 1
            else:
                break
        if s[self.i] == K["extends"] and not self.no_conditional:
            self.i += 1
            self.type()
            if self.take("?"):
                self.type()
                self.need(":")
                self.type()

    no_conditional = False

    def function_type(self) -> bool:
        e = self.match.get(self.i)
        return e is not None and self.s[e + 1] == ARROW

    def type_primary(self) -> None:
        s = self.s
        c = s[self.i]
        while c in K["keyof"] + K["readonly"] + K["infer"] + K["unique"] and (s[self.i + 1] in WORDS or s[self.i + 1] in "[({" + STR):
            self.i += 1
            c = s[self.i]
        if c == K["typeof"]:
            self.i += 1
            if s[self.i] == K["import"]:
                c = s[self.i]
            else:
                c = ID
        if c == K["import"]:
            self.i += 1
            self.need("(")
            self.type()
            self.need(")")
            while self.take("."):
                self.i += 1
            if s[self.i] == "<":
                self.type_args()
        elif c in NAMES or c in K["this"] + K["null"] + K["void"] + K["true"] + K["false"]:
            self.i += 1
            while s[self.i] == "." and s[self.i + 1] in WORDS:
                self.i += 2
            if s[self.i] == "<":
                self.type_args()
        elif c == STR or c == NUM:
            self.i += 1
        elif c == "-" and s[self.i + 1] == NUM:
            self.i += 2
        elif c == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif c == "{":
            self.type_members()
        elif c == "[":
            self.i += 1
            while s[self.i] != "]":
                self.take(DOTS)
                if s[self.i] in NAMES and (s[self.i + 1] == ":" or s[self.i + 1] == "?" and s[self.i + 2] == ":"):
                    self.i += 2 if s[self.i + 1] == ":" else 3
                self.type()
                self.take("?")
                if s[self.i] != "]":
                    self.need(",")
            self.i += 1
        else:
            self.fail()
        while s[self.i] == "[" and not (s[self.i - 1] != "]" and self.newline_before(self.i)):
            self.i += 1
            if s[self.i] != "]":
                self.type()
            self.need("]")

    def type_args(self) -> None:
        self.need("<")
        while True:
            self.type()
            if not self.take(","):
                break
        self.need(">")

    def type_params(self) -> None:
        self.need("<")
        while True:
            while self.s[self.i] in K["const"] + K["in"] and self.s[self.i + 1] in NAMES:
                self.i += 1
            self.names()
            if self.take(K["extends"]):
                self.type()
            if self.take("="):
                self.type()
            if not self.take(",") or self.s[self.i] == ">":
                break
        self.need(">")

    # expressions ---------------------------------------------------------------
    def expr(self, use_in: bool = True) -> None:
        self.assignment(use_in)
        while self.take(","):
            self.assignment(use_in)

    def assignment(self, use_in: bool = True) -> None:
        s, at = self.s, self.i
        c = s[at]
        if c == ASYNC and s[at + 1] in NAMES and s[at + 2] == ARROW:
            self.i += 2
            self.arrow(at)
            return
        if c in NAMES and s[at + 1] == ARROW:
            self.i += 1
            self.arrow(at)
            return
        k = at + 1 if c == ASYNC and s[at + 1] == "(" else at
        if s[k] == "(":
            e = self.match.get(k)
            if e is not None and (s[e + 1] == ARROW or self.ts and s[e + 1] == ":"):
                self.i = k
                if s[e + 1] == ARROW:
                    self.group("p" if not self.ts else "P", self.params)
                    self.arrow(at)
                    return
                if self.attempt(self.typed_arrow_head):
                    self.arrow(at)
                    return
                self.i = at
        if self.ts and c == "<" and self.attempt(self.typed_arrow_head):
            self.arrow(at)
            return
        if c == K["yield"] and s[at + 1] not in ".([=" + ARROW:
            self.i += 1
            self.take("*")
            if s[self.i] not in ")]};,:" + EOF:
                self.assignment(use_in)
            return
        self.binary(1, use_in)
        c = s[self.i]
        if c == "?":
            self.i += 1
            self.assignment()
            self.need(":")
            self.assignment(use_in)
        elif c in ASSIGN:
            if s[self.i - 1] in NUM + STR + "R" + ASSIGN or s[self.i - 1] in "+-":
                self.fail()
            self.i += 1
            self.assignment(use_in)

    def typed_arrow_head(self):
        self.take(ASYNC)
        self.signature()
        return self.s[self.i] == ARROW or self.fail()

    def arrow(self, at: int) -> None:
        head = self.i
        self.need(ARROW)
        if self.s[self.i] == "{":
            self.block()
        else:
            self.assignment()
        self.last_arrow, self.head_end = (at, self.i), head

    def binary(self, least: int, use_in: bool = True) -> None:
        s = self.s
        self.unary()
        while True:
            c = s[self.i]
            p = BINARY.get(c)
            if p is None:
                if self.ts and (c == AS or c == SAT) and not self.newline_before(self.i):
                    self.i += 1
                    if not self.take(K["const"]):
                        self.type()
                    continue
                return
            if p < least or c == IN and not use_in:
                return
            self.i += 1
            if c == ">" and s[self.i] == ">":  # shifts come as single marks, for type arguments
                while s[self.i] == ">":
                    self.i += 1
            elif c == "*" and s[self.i] == "*":
                self.fail()
            self.binary(p + (c != K["**"]), use_in)

    def unary(self) -> None:
        s = self.s
        while s[self.i] in PREFIX and not (s[self.i] == K["await"] and s[self.i + 1] in ").,;=:]"):
            self.i += 1
        if self.ts and s[self.i] == "<":
            self.type_args()
            self.unary()
            return
        if s[self.i] == "#" and s[self.i + 1] in WORDS:
            self.i += 2
            return
        self.postfix_expr()
        if s[self.i] in INCDEC and not self.newline_before(self.i):
            self.i += 1

    def postfix_expr(self) -> None:
        s = self.s
        self.primary()
        while True:
            c = s[self.i]
            if c == ".":
                self.i += 1
                self.take("#")
                if s[self.i] not in WORDS:
                    self.fail()
                self.i += 1
            elif c == "(":
                self.group("a" if not self.ts else "A", self.args)
            elif c == "[":
                self.i += 1
                self.expr()
                self.need("]")
            elif c == QDOT:
                self.i += 1
                if s[self.i] == "(":
                    self.args()
                elif self.take("["):
                    self.expr()
                    self.need("]")
                elif self.take("#") or s[self.i] in WORDS:
                    self.i += 1
                else:
                    self.fail()
            elif c == STR and self.toks_at(self.i)[:1] == "`":
                self.i += 1
            elif self.ts and c == "!" and not self.newline_before(self.i):
                self.i += 1
            elif self.ts and c == "<" and self.attempt(self.call_type_args):
                pass
            else:
                return

    def call_type_args(self):
        self.type_args()
        return self.s[self.i] in "(" + STR or self.fail()

    def toks_at(self, at: int) -> str:
        return self.text[self.positions()[0][at] :][:1]

    def args(self) -> None:
        self.need("(")
        self.items(")")

    def items(self, close: str) -> None:
        s = self.s
        while s[self.i] != close:
            m = LITERALS.match(s, self.i)
            if m:
                self.i = m.end()
                continue
            if close == "]" and self.take(","):
                continue
            self.take(DOTS)
            self.assignment()
            if s[self.i] != close:
                self.need(",")
        self.i += 1

    def object(self) -> None:
        s = self.s
        self.need("{")
        while s[self.i] != "}":
            start = self.i
            if self.take(DOTS):
                self.assignment()
            else:
                if s[self.i] == ASYNC and s[self.i + 1] not in ",:(}=":
                    self.i += 1
                self.take("*")
                if s[self.i] in (K["get"], K["set"]) and s[self.i + 1] not in ",:(}=":
                    self.i += 1
                name = self.i
                self.property_name()
                if self.take(":"):
                    at, n = self.i, len(self.funcs)
                    self.assignment()
                    if s[name] in WORDS:
                        self.assigned(start, name, at, n)
                elif s[self.i] == "(" or self.ts and s[self.i] == "<":
                    self.signature()
                    head = self.i
                    self.block()
                    if s[name] in WORDS:
                        self.funcs.append(Func(start, name, head, self.i, kind="method"))
                elif s[name] in NAMES:
                    if self.take("="):
                        self.assignment()
                else:
                    self.fail()
            if s[self.i] != "}":
                self.need(",")
        self.i += 1

    def primary(self) -> None:
        s = self.s
        c = s[self.i]
        if c == ASYNC and s[self.i + 1] == FUNCTION:
            self.function(None, False)
        elif c in ATOMS:
            self.i += 1
        elif c == "(":
            self.i += 1
            self.expr()
            self.need(")")
        elif c == "[":
            self.i += 1
            self.items("]")
        elif c == "{":
            self.object()
        elif c == FUNCTION:
            self.function(None, False)
        elif c == CLASS:
            self.klass(False)
        elif c == "@":
            while s[self.i] == "@":
                self.decorator()
            self.klass(False)
        elif c == NEW:
            self.i += 1
            if s[self.i] == ".":
                self.i += 2
                return
            self.new_target()
        elif c == K["import"]:
            self.i += 1
            if self.take("."):
                self.i += 1
            elif s[self.i] != "(":
                self.fail()
        else:
            self.fail()

    def new_target(self) -> None:
        s = self.s
        if self.take(NEW):
            self.new_target()
        else:
            self.primary()
        while True:
            if s[self.i] == ".":
                self.i += 1
                self.take("#")
                if s[self.i] not in WORDS:
                    self.fail()
                self.i += 1
            elif s[self.i] == "[":
                self.i += 1
                self.expr()
                self.need("]")
            else:
                break
        if self.ts and s[self.i] == "<":
            self.attempt(self.type_args)
        if s[self.i] == "(":
            self.args()

    def decorated(self) -> None:
        while self.s[self.i] == "@":
            self.decorator()
        if self.s[self.i] not in (K["export"], CLASS, K["abstract"]):
            self.fail()
        self.statement()


TS_DECL = "".join(K[w] for w in words("declare abstract namespace module type interface"))
EXPORTS = K["export"] + K["default"] + K["declare"]


def debugger(self) -> None:
    self.i += 1
    self.semi()


DISPATCH = {K[w]: f for w, f in {"if": Ecma.if_, "for": Ecma.for_, "while": Ecma.while_, "do": Ecma.do, "switch": Ecma.switch, "try": Ecma.try_, "with": Ecma.while_, "function": Ecma.function, "class": Ecma.klass, "var": Ecma.var, "const": Ecma.var, "import": Ecma.import_, "export": Ecma.export, "enum": Ecma.enum, "debugger": debugger, "@": Ecma.decorated, **dict.fromkeys(words("return throw break continue"), Ecma.jump)}.items()}


class JavaScript(Ecma):
    memo: dict = {}


class TypeScript(Ecma):
    memo: dict = {}
    ts = True
