"""Go."""

from __future__ import annotations

import re

from .core import BAD, EOF, ID, LITERALS, NUM, STR, Classes, Func, Parser, words

# fixed values: keywords and operators of Go
KEYWORDS = words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
OPERATORS = words("<- := ... ++ -- && || == != <= >= << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= = < > + - * / % & | ^ ! ~ : ; , . ( ) [ ] { }")
NUMBER = re.compile(r"(?:0[xX](?:_?[0-9a-fA-F])*(?:\.(?:[0-9a-fA-F_])*)?(?:[pP][+-]?[0-9]+)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9]+)?)i?\Z")
PATTERN = re.compile(
    r"[ \t\r﻿]+|\n\s*|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|/\*|[^\W\d]\w*|\.?[0-9](?:[\w.]|(?<=[eEpP])[+-](?=[0-9]))*"
    r"|`[^`]*`|\"(?:[^\"\\\n]|\\[abfnrtvxuU0-7\\\"])*\"|'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'"
    r"|<<=|>>=|&\^=|\.\.\.|<-|:=|\+\+|--|&&|\|\||==|!=|<=|>=|<<|>>|&\^|[+\-*/%&|^]=|[\s\S]"
)
NL = "n"


def classify(tok: str) -> str:
    c = tok[0]
    if c == "\n":
        return NL
    if c in " \t\r﻿" or tok.startswith("//"):
        return ""
    if tok.startswith("/*"):
        return BAD if len(tok) < 4 else NL if "\n" in tok else ""
    if c.isalpha() or c == "_":
        return ID
    if c.isdigit() or c == "." and len(tok) > 1:
        return NUM if NUMBER.match(tok) else BAD
    if c in "\"'`" and len(tok) > 1:
        return STR
    return BAD


CLASSES = Classes(KEYWORDS + OPERATORS, classify)
K = CLASSES.fixed
ENDS = ID + NUM + STR + ")]}" + "".join(K[w] for w in words("break continue fallthrough return ++ --"))
AUTO = re.compile("(?<=[" + re.escape(ENDS) + "])n")
BINARY = {K[o]: p for p, row in enumerate(["||", "&&", "== != < <= > >=", "+ - | ^", "* / % << >> & &^"], 1) for o in row.split()}
ASSIGN = "".join(K[o] for o in words("= += -= *= /= %= &= |= ^= <<= >>= &^="))
PREFIX = "+-!^*&~" + K["<-"]
DEFINE, DOTS, RANGE, FUNC, LARROW = (K[w] for w in words(":= ... range func <-"))
INCDEC = K["++"] + K["--"]
TYPE_START = "".join(K[w] for w in words("map chan struct interface func")) + "[*(" + ID + LARROW


class Go(Parser):
    classes, pattern, memo = CLASSES, PATTERN, {}
    level = 0  # below 0 in the header of a statement, where a brace opens the block

    def lex(self) -> None:
        self.codes = list(map(self.classes.__getitem__, self.toks))
        self.s = AUTO.sub(";", "".join(self.codes)).replace(NL, "")
        if self.s and self.s[-1] in ENDS:
            self.s += ";"

    def kept(self) -> list[int]:
        out, last = [], ""
        for k, c in enumerate(self.codes):
            if c == NL:
                if last and last in ENDS:
                    out.append(-1)
                    last = ";"
            elif c:
                out.append(k)
                last = c
        return out + [-1]

    def program(self) -> None:
        if self.i == 0:
            at = 0
            try:
                self.need(K["package"])
                self.need(ID)
                self.end()
            except Exception as e:
                if not hasattr(e, "what"):
                    raise
                self.recover(e, at)
                if not self.s[self.i :].strip(EOF):
                    return
        self.statements("}", self.top)

    def end(self) -> None:
        if self.s[self.i] not in ")}" + EOF:
            self.need(";")

    def top(self) -> None:
        c = self.s[self.i]
        if c == ";":
            self.i += 1
        elif c == K["import"]:
            self.i += 1
            self.grouped(self.import_)
            self.end()
        elif c == FUNC:
            self.func_decl()
            self.end()
        elif c in (K["var"], K["const"], K["type"]):
            self.declaration()
            self.end()
        else:
            self.fail()

    def grouped(self, one) -> None:
        if self.take("("):
            while self.s[self.i] != ")":
                one()
                if self.s[self.i] != ")":
                    self.need(";")
            self.i += 1
        else:
            one()

    def import_(self) -> None:
        if self.s[self.i] in ID + ".":
            self.i += 1
        self.need(STR)

    def declaration(self) -> None:
        c = self.s[self.i]
        self.i += 1
        self.grouped({K["var"]: self.var_spec, K["const"]: self.const_spec, K["type"]: self.type_spec}[c])

    def names(self) -> None:
        self.need(ID)
        while self.take(","):
            self.need(ID)

    def var_spec(self) -> None:
        self.names()
        if self.s[self.i] != "=":
            self.type()
        if self.take("="):
            self.exprs()

    def const_spec(self) -> None:
        self.names()
        if self.s[self.i] not in "=;)":
            self.type()
        if self.take("="):
            self.exprs()

    def type_spec(self) -> None:
        self.need(ID)
        if self.s[self.i] == "[" and self.s[self.i + 1] == ID and self.s[self.i + 2] != "]":
            self.attempt(self.type_params)
        self.take("=")
        self.type()

    def type_params(self):
        self.need("[")
        while self.s[self.i] != "]":
            self.names()
            self.constraint()
            if self.s[self.i] != "]":
                self.need(",")
        self.i += 1
        return True

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type()
            if not self.take("|"):
                return

    def func_decl(self) -> None:
        start = self.i
        self.i += 1
        owner = -1
        if self.s[self.i] == "(":
            e = self.match.get(self.i)
            self.params()
            owner = (e or 0) - 1
            if self.s[owner] == "]":
                owner = self.match and next((k - 1 for k, v in self.match.items() if v == owner), -1)
        name = self.i
        self.need(ID)
        if self.s[self.i] == "[":
            self.type_params()
        self.signature()
        head = self.i
        if self.s[self.i] == "{":
            self.block()
        self.funcs.append(Func(start, name, head, self.i, kind="function" if owner < 0 else "method", owner=owner))

    def signature(self) -> None:
        if self.s[self.i] != "(":
            self.fail()
        self.group("p", self.params)
        if self.s[self.i] == "(":
            self.group("p", self.params)
        elif self.s[self.i] in TYPE_START:
            self.type()

    def params(self) -> None:
        """Names with types or types alone; both fit `[name] [...] type` item by item."""
        s = self.s
        self.need("(")
        while s[self.i] != ")":
            if s[self.i] == ID and s[self.i + 1] == DOTS:
                self.i += 1
            if self.take(DOTS):
                self.type()
            else:
                self.type()
                if s[self.i] not in ",)":
                    if s[self.i - 1] != ID:
                        self.fail()
                    self.take(DOTS)
                    self.type()
            if s[self.i] != ")":
                self.need(",")
        self.i += 1

    def type(self) -> None:
        s = self.s
        c = s[self.i]
        if c == ID:
            self.i += 1
            if s[self.i] == "." and s[self.i + 1] == ID:
                self.i += 2
            if s[self.i] == "[" and s[self.i + 1] not in "]" + NUM:
                self.attempt(self.type_args)
        elif c == "*":
            self.i += 1
            self.type()
        elif c == "[":
            self.i += 1
            if s[self.i] != "]":
                if not self.take(DOTS):
                    self.level, before = 1, self.level
                    self.expr()
                    self.level = before
            self.need("]")
            self.type()
        elif c == K["map"]:
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif c == K["chan"]:
            self.i += 1
            self.take(LARROW)
            self.type()
        elif c == LARROW:
            self.i += 1
            self.need(K["chan"])
            self.type()
        elif c == FUNC:
            self.i += 1
            self.signature()
        elif c == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif c == K["struct"]:
            self.i += 1
            self.need("{")
            while s[self.i] != "}":
                if s[self.i] == "*" or s[self.i] == ID and s[self.i + 1] in ";}." + STR:
                    self.type()
                else:
                    self.names()
                    self.type()
                self.take(STR)
                if s[self.i] != "}":
                    self.need(";")
            self.i += 1
        elif c == K["interface"]:
            self.i += 1
            self.need("{")
            while s[self.i] != "}":
                if s[self.i] == ID and s[self.i + 1] == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                if s[self.i] != "}":
                    self.need(";")
            self.i += 1
        else:
            self.fail()

    def type_args(self):
        self.need("[")
        while self.s[self.i] != "]":
            self.type()
            if self.s[self.i] != "]":
                self.need(",")
        self.i += 1
        return True

    # statements --------------------------------------------------------------------
    def block(self) -> None:
        self.need("{")
        before, self.level = self.level, 0
        self.statements("}", self.statement)
        self.level = before
        self.need("}")

    def statement(self) -> None:
        c = self.s[self.i]
        f = DISPATCH.get(c)
        if f is not None:
            f(self)
        elif c == ";":
            self.i += 1
            return
        elif c == "{":
            self.block()
        elif c == ID and self.s[self.i + 1] == ":" :
            self.i += 2
            if self.s[self.i] not in "};":
                self.statement()
            return
        else:
            end = self.stretch(self.i)
            if end is not None:
                self.remember("s", end, self.simple_end)
                return
            self.simple()
        self.end()

    def simple_end(self) -> None:
        self.simple()
        self.end()

    def simple(self) -> None:
        self.exprs()
        c = self.s[self.i]
        if c == DEFINE or c in ASSIGN:
            self.i += 1
            if self.s[self.i] == RANGE and self.level < 0:
                return
            self.exprs()
        elif c in INCDEC:
            self.i += 1
        elif c == LARROW:
            self.i += 1
            self.expr()

    def header(self, empty_ok: bool) -> None:
        """[simple ;] [simple] before a block."""
        s = self.s
        before, self.level = self.level, -1
        if s[self.i] not in "{;":
            self.simple()
        if self.take(";"):
            if s[self.i] != "{":
                self.simple()
            elif not empty_ok:
                self.fail()
        self.level = before

    def remembered_header(self, tag: str, f, *args) -> None:
        """Headers without braces end before the first brace on this level."""
        k = self.s.find("{", self.i)
        if k < 0 or k == self.i:
            f(*args)
        else:
            self.remember(tag, k - 1, f, *args)

    def if_(self) -> None:
        self.i += 1
        if self.s[self.i] == "{":
            self.fail("expected a condition before ")
        self.remembered_header("i", self.header, False)
        self.block()
        if self.take(K["else"]):
            if self.s[self.i] == K["if"]:
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        self.i += 1
        self.remembered_header("f", self.for_head)
        self.block()

    def for_head(self) -> None:
        s = self.s
        before, self.level = self.level, -1
        if s[self.i] != "{":
            if s[self.i] != RANGE and s[self.i] != ";":
                self.simple()
            if s[self.i] == RANGE and s[self.i - 1] in (K["for"], DEFINE, "="):
                self.i += 1
                self.expr()
            elif self.take(";"):
                if s[self.i] != ";":
                    self.expr()
                self.need(";")
                if s[self.i] != "{":
                    self.simple()
        self.level = before

    def switch(self) -> None:
        self.i += 1
        self.remembered_header("w", self.header, True)
        self.need("{")
        while self.s[self.i] != "}":
            if self.take(K["case"]):
                self.case_exprs()
            else:
                self.need(K["default"])
            self.need(":")
            self.statements("}" + K["case"] + K["default"], self.statement)
        self.i += 1

    def case_exprs(self) -> None:
        self.expr()
        while self.take(","):
            self.expr()

    def select(self) -> None:
        self.i += 1
        self.need("{")
        while self.s[self.i] != "}":
            if self.take(K["case"]):
                self.simple()
            else:
                self.need(K["default"])
            self.need(":")
            self.statements("}" + K["case"] + K["default"], self.statement)
        self.i += 1

    def jump(self) -> None:
        c = self.s[self.i]
        self.i += 1
        if c == K["return"]:
            if self.s[self.i] not in ";}":
                self.exprs()
        elif c in (K["go"], K["defer"]):
            self.expr()
        elif c != K["fallthrough"]:
            self.take(ID)

    # expressions ---------------------------------------------------------------------
    def exprs(self) -> None:
        self.expr()
        while self.take(","):
            self.expr()

    def expr(self) -> None:
        self.binary(1)

    def binary(self, least: int) -> None:
        s = self.s
        while s[self.i] in PREFIX:
            self.i += 1
        self.primary()
        while True:
            p = BINARY.get(s[self.i])
            if p is None or p < least:
                return
            self.i += 1
            self.binary(p + 1)

    def inner(self, f) -> None:
        before, self.level = self.level, 0
        f()
        self.level = before

    def primary(self) -> None:
        s = self.s
        c = s[self.i]
        literal = False  # may a composite literal's brace follow?
        if c == ID:
            self.i += 1
            literal = True
        elif c == NUM or c == STR:
            self.i += 1
        elif c == "(":
            self.i += 1
            self.inner(self.type_or_expr)
            self.need(")")
        elif c == FUNC:
            self.i += 1
            self.signature()
            if s[self.i] == "{":
                self.block()
        elif c in "[" + K["map"] + K["struct"] + K["chan"] + K["interface"]:
            self.type()
            if s[self.i] == "{":
                self.inner(self.literal)
            elif s[self.i] != "(" and s[self.i] not in ",)":
                self.fail()
        else:
            self.fail()
        while True:
            c = s[self.i]
            if c == ".":
                self.i += 1
                if self.take("("):
                    if not self.take(K["type"]):
                        self.type()
                    self.need(")")
                    literal = False
                else:
                    self.need(ID)
            elif c == "(":
                self.inner(self.args)
                literal = False
            elif c == "[":
                self.inner(self.index)
            elif c == "{" and literal and self.level >= 0:
                self.inner(self.literal)
                literal = False
            else:
                return

    def type_or_expr(self) -> None:
        at = self.i
        if not (self.attempt(self.expr) and self.s[self.i] == ")"):
            self.i = at
            self.type()

    def index(self) -> None:
        s = self.s
        self.need("[")
        if s[self.i] != ":":
            self.type_or_index()
        while self.take(":") or self.take(","):
            if s[self.i] not in ":]":
                self.type_or_index()
        self.need("]")

    def type_or_index(self) -> None:
        if not self.attempt(self.expr):
            self.type()

    def args(self) -> None:
        s = self.s
        self.need("(")
        while s[self.i] != ")":
            m = LITERALS.match(s, self.i)
            if m:
                self.i = m.end()
                continue
            if not self.attempt(self.expr_then):
                self.type()
            self.take(DOTS)
            if s[self.i] != ")":
                self.need(",")
        self.i += 1

    def expr_then(self):
        self.expr()
        return self.s[self.i] in ",)" + DOTS or self.fail()

    def literal(self) -> None:
        s = self.s
        self.need("{")
        while s[self.i] != "}":
            m = LITERALS.match(s, self.i)
            if m:
                self.i = m.end()
                continue
            self.element()
            if self.take(":"):
                self.element()
            if s[self.i] != "}":
                self.need(",")
        self.i += 1

    def element(self) -> None:
        if self.s[self.i] == "{":
            self.literal()
        else:
            self.expr()


DISPATCH = {K[w]: f for w, f in {"if": Go.if_, "for": Go.for_, "switch": Go.switch, "select": Go.select, **dict.fromkeys(words("var const type"), Go.declaration), **dict.fromkeys(words("return go defer break continue goto fallthrough"), Go.jump)}.items()}
