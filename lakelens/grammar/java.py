"""Java."""

from __future__ import annotations

import re

from .core import BAD, EOF, ID, LITERALS, NUM, STR, Classes, Func, Parser, words

# fixed values: keywords, contextual words and operators of Java
KEYWORDS = words("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null")
CONTEXTUAL = words("record sealed permits yield var non when module open")
OPERATORS = words("-> :: ++ -- && || == != <= >= << += -= *= /= %= &= |= ^= <<= >>= >>>= ... = < > + - * / % & | ^ ! ~ ? : ; , . ( ) [ ] { } @")
NUMBER = re.compile(r"(?:0[xX](?:[0-9a-fA-F_]+\.?[0-9a-fA-F_]*|\.[0-9a-fA-F_]+)(?:[pP][+-]?[0-9]+[fFdD]?|[lL])?|0[bB][01_]+[lL]?|(?:[0-9][0-9_]*\.?(?:[0-9][0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?[fFdDlL]?)\Z")
PATTERN = re.compile(
    r"\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|/\*|[^\W\d][\w$]*|\$[\w$]*|\.?[0-9](?:[\w.]|(?<=[eEpP])[+-](?=[0-9]))*"
    r'|"""[ \t\r\f]*\n(?:[^"\\]|\\[\s\S]|"(?!""))*"""|"(?:[^"\\\n]|\\[btnfrsu0-7"\'\\])*"'
    r"|'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\[btnfrs\"'\\])'"
    r"|>>>=|>>=|<<=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|<<|[+\-*/%&|^]=|[\s\S]"
)


def classify(tok: str) -> str:
    c = tok[0]
    if c.isspace() or tok.startswith("//") or c == "﻿" or tok == "\x1a":
        return ""
    if tok.startswith("/*"):
        return "" if len(tok) > 3 else BAD
    if c.isalpha() or c in "_$":
        return ID
    if c.isdigit() or c == "." and len(tok) > 1:
        return NUM if NUMBER.match(tok) else BAD
    if c in "\"'" and len(tok) > 1:
        return STR
    return BAD


CLASSES = Classes(KEYWORDS + CONTEXTUAL + OPERATORS, classify)
K = CLASSES.fixed
NAMES = ID + "".join(K[w] for w in CONTEXTUAL)
PRIMITIVE = "".join(K[w] for w in words("boolean byte char short int long float double"))
MODS = "".join(K[w] for w in words("public protected private static abstract final native synchronized transient volatile strictfp default sealed"))
BINARY = {K[o]: p for p, row in enumerate(["||", "&&", "|", "^", "&", "== !=", "< > <= >= instanceof", "<<", "+ -", "* / %"], 1) for o in row.split()}
ASSIGN = "".join(K[o] for o in words("= += -= *= /= %= &= |= ^= <<= >>= >>>="))
PREFIX = "+-!~" + K["++"] + K["--"]
INCDEC = K["++"] + K["--"]
ARROW, REF, DOTS, SUPER, THIS, CLASS, NEW = (K[w] for w in words("-> :: ... super this class new"))
LITERAL = NUM + STR + "".join(K[w] for w in words("true false null"))
CAST_NEXT = NAMES + LITERAL + "(!~" + "".join(K[w] for w in words("this super new switch void")) + PRIMITIVE


class Java(Parser):
    classes, pattern, memo = CLASSES, PATTERN, {}

    def program(self) -> None:
        s = self.s
        if self.i == 0:
            at = 0
            try:
                while s[self.i] == "@" and s[self.i + 1] != K["interface"]:
                    self.annotation()
                if self.take(K["package"]):
                    self.qualified()
                    self.need(";")
                else:
                    self.i = at
            except Exception as e:
                if not hasattr(e, "what"):
                    raise
                self.recover(e, at)
        self.statements("}", self.top)

    def top(self) -> None:
        if self.take(";"):
            return
        if self.take(K["import"]):
            self.take(K["static"])
            self.qualified(True)
            self.need(";")
            return
        start = self.i
        self.modifiers()
        if not self.type_declaration(start):
            self.fail()

    def qualified(self, star: bool = False) -> None:
        self.name()
        while self.take("."):
            if star and self.take("*"):
                return
            self.name()

    def name(self) -> None:
        if self.s[self.i] not in NAMES:
            self.fail()
        self.i += 1

    def annotation(self) -> None:
        self.need("@")
        self.qualified()
        if self.s[self.i] == "(":
            self.i += 1
            if not self.take(")"):
                while True:
                    if self.s[self.i] in NAMES and self.s[self.i + 1] == "=":
                        self.i += 2
                    self.annotation_value()
                    if not self.take(","):
                        break
                self.need(")")

    def annotation_value(self) -> None:
        if self.s[self.i] == "@":
            self.annotation()
        elif self.take("{"):
            while self.s[self.i] != "}":
                self.annotation_value()
                if self.s[self.i] != "}":
                    self.need(",")
            self.i += 1
        else:
            self.ternary()

    def modifiers(self) -> None:
        s = self.s
        while True:
            c = s[self.i]
            if c == "@" and s[self.i + 1] != K["interface"]:
                self.annotation()
            elif c in MODS and not (c == K["default"] and s[self.i + 1] in ":" + ARROW) and not (c == K["sealed"] and s[self.i + 1] in "(.=;,"):
                self.i += 1
            elif c == K["non"] and s[self.i + 1] == "-":
                self.i += 3
            else:
                return

    def type_declaration(self, start: int) -> bool:
        s = self.s
        c = s[self.i]
        if c == CLASS:
            self.i += 1
            self.name()
            owner = self.i - 1
            self.type_params_opt()
            if self.take(K["extends"]):
                self.type()
            if self.take(K["implements"]):
                self.types()
            if self.take(K["permits"]):
                self.types()
            self.body(owner)
        elif c == K["interface"] or c == "@" and s[self.i + 1] == K["interface"]:
            self.i += 1 + (c == "@")
            self.name()
            owner = self.i - 1
            self.type_params_opt()
            if self.take(K["extends"]):
                self.types()
            if self.take(K["permits"]):
                self.types()
            self.body(owner)
        elif c == K["enum"]:
            self.i += 1
            self.name()
            owner = self.i - 1
            if self.take(K["implements"]):
                self.types()
            self.need("{")
            while s[self.i] not in ";}":
                while s[self.i] == "@":
                    self.annotation()
                self.name()
                if s[self.i] == "(":
                    self.args()
                if s[self.i] == "{":
                    self.body(owner)
                if s[self.i] not in ";}":
                    self.need(",")
            if self.take(";"):
                self.members(owner)
            self.need("}")
        elif c == K["record"] and s[self.i + 1] in NAMES and s[self.i + 2] in "(<":
            self.i += 2
            owner = self.i - 1
            self.type_params_opt()
            self.params()
            if self.take(K["implements"]):
                self.types()
            self.body(owner)
        else:
            return False
        return True

    def types(self) -> None:
        self.type()
        while self.take(","):
            self.type()

    def body(self, owner: int) -> None:
        self.need("{")
        self.members(owner)
        self.need("}")

    def members(self, owner: int) -> None:
        before, self.owner = getattr(self, "owner", -1), owner
        self.statements("}", self.member)
        self.owner = before

    def member(self) -> None:
        s, start = self.s, self.i
        if self.take(";"):
            return
        if s[start] == "{" or s[start] == K["static"] and s[start + 1] == "{":
            self.take(K["static"])
            self.block()
            return
        self.modifiers()
        if self.type_declaration(start):
            return
        self.type_params_opt()
        if s[self.i] in NAMES and s[self.i + 1] in "({" and s[self.i] != K["record"]:
            name = self.i
            self.i += 1
            if s[self.i] == "(":
                self.group("p", self.params)
                self.throws()
            self.method_end(start, name, False)
            return
        if s[self.i] == K["void"]:
            self.i += 1
        else:
            self.type()
        name = self.i
        self.name()
        if s[self.i] == "(":
            self.group("p", self.params)
            self.dims()
            self.throws()
            if self.take(K["default"]):
                self.annotation_value()
            self.method_end(start, name, True)
            return
        self.declarators()
        self.need(";")

    def throws(self) -> None:
        if self.take(K["throws"]):
            self.types()

    def method_end(self, start: int, name: int, bodiless: bool) -> None:
        head = self.i
        if bodiless and self.take(";"):
            self.funcs.append(Func(start, name, head, self.i, kind="method", owner=self.owner))
            return
        self.block()
        self.funcs.append(Func(start, name, head, self.i, kind="method", owner=self.owner))

    def dims(self) -> None:
        while self.s[self.i] == "[" and self.s[self.i + 1] == "]":
            self.i += 2

    def params(self) -> None:
        s = self.s
        self.need("(")
        while s[self.i] != ")":
            self.modifiers()
            self.type()
            if s[self.i] == "@":
                self.annotation()
            self.take(DOTS)
            if s[self.i] in NAMES and s[self.i + 1] == "." and s[self.i + 2] == THIS:
                self.i += 3
            elif not self.take(THIS):
                self.name()
            self.dims()
            if s[self.i] != ")":
                self.need(",")
                if s[self.i] == ")":
                    self.fail()
        self.i += 1

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.dims()
            if self.take("="):
                self.initializer()
            if not self.take(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.s[self.i] == "{":
            self.i += 1
            while self.s[self.i] != "}":
                m = LITERALS.match(self.s, self.i)
                if m:
                    self.i = m.end()
                    continue
                self.initializer()
                if self.s[self.i] != "}":
                    self.need(",")
            self.i += 1
        else:
            self.expr()

    # types -----------------------------------------------------------------------
    def type_params_opt(self) -> None:
        if self.take("<"):
            while True:
                while self.s[self.i] == "@":
                    self.annotation()
                self.name()
                if self.take(K["extends"]):
                    self.type()
                    while self.take("&"):
                        self.type()
                if not self.take(","):
                    break
            self.need(">")

    def type(self) -> None:
        s = self.s
        while s[self.i] == "@":
            self.annotation()
        c = s[self.i]
        if c in PRIMITIVE:
            self.i += 1
        else:
            while True:
                self.name()
                if s[self.i] == "<":
                    self.type_args()
                if s[self.i] == "." and (s[self.i + 1] in NAMES or s[self.i + 1] == "@"):
                    self.i += 1
                    while s[self.i] == "@":
                        self.annotation()
                else:
                    break
        self.dims()

    def type_args(self) -> None:
        self.need("<")
        if self.take(">"):
            return
        while True:
            while self.s[self.i] == "@":
                self.annotation()
            if self.take("?"):
                if self.take(K["extends"]) or self.take(SUPER):
                    self.type()
            else:
                self.type()
            if not self.take(","):
                break
        self.need(">")

    # statements --------------------------------------------------------------------
    def block(self) -> None:
        self.need("{")
        self.statements("}", self.statement)
        self.need("}")

    def paren(self) -> None:
        self.need("(")
        self.expr()
        self.need(")")

    def statement(self) -> None:
        s, i = self.s, self.i
        c = s[i]
        f = DISPATCH.get(c)
        if f is not None and not (c == K["yield"] and s[i + 1] in "=.[(" + INCDEC) and not (c == K["switch"] and False):
            f(self)
            return
        if c == ";":
            self.i += 1
            return
        if c == "{":
            self.block()
            return
        if c in NAMES and s[i + 1] == ":":
            self.i += 2
            self.statement()
            return
        if c in MODS or c == "@" or c in (CLASS, K["interface"], K["enum"]) or c == K["record"] and s[i + 1] in NAMES and s[i + 2] in "(<":
            if c == K["synchronized"]:
                self.i += 1
                self.group("c", self.paren)
                self.block()
                return
            self.modifiers()
            if self.type_declaration(i):
                return
            self.type()
            self.name()
            self.declarators()
            self.need(";")
            return
        end = self.stretch(i)
        if end is None:
            self.simple()
        else:
            self.remember("s", end, self.simple)

    def simple(self) -> None:
        self.simple_head()
        self.need(";")

    def simple_head(self) -> None:
        """A local variable declaration or an expression that may stand as a statement."""
        s = self.s
        if (s[self.i] in NAMES or s[self.i] in PRIMITIVE) and self.attempt(self.declaration_head):
            self.declarators()
            return
        at = self.i
        self.expr()
        if s[at] not in PREFIX and s[self.i - 1] not in ")" + INCDEC and not self.was_statement:
            self.fail("not a statement before ")

    was_statement = False

    def declaration_head(self):
        self.type()
        self.name()
        return self.s[self.i] in "=;,:[" or self.fail()

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
        self.need(";")

    def for_(self) -> None:
        self.i += 1
        if self.s[self.i] != "(":
            self.fail()
        self.group("f", self.for_head)
        self.statement()

    def for_head(self) -> None:
        s = self.s
        self.need("(")
        if s[self.i] != ";":
            self.modifiers()
            self.simple_head()
            while self.take(","):
                self.expr()
            if self.take(":"):
                self.expr()
                self.need(")")
                return
        self.need(";")
        if s[self.i] != ";":
            self.expr()
        self.need(";")
        if s[self.i] != ")":
            self.expr()
            while self.take(","):
                self.expr()
        self.need(")")

    def try_(self) -> None:
        s = self.s
        self.i += 1
        seen = False
        if self.take("("):
            seen = True
            while s[self.i] != ")":
                self.modifiers()
                if self.attempt(self.declaration_head):
                    self.need("=")
                self.expr()
                if s[self.i] != ")":
                    self.need(";")
            self.i += 1
        self.block()
        while self.take(K["catch"]):
            seen = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.take("|"):
                self.type()
            self.name()
            self.need(")")
            self.block()
        if self.take(K["finally"]):
            seen = True
            self.block()
        if not seen:
            self.fail("expected catch or finally before ")

    def switch(self) -> None:
        self.i += 1
        self.group("c", self.paren)
        self.switch_body()

    def switch_body(self) -> None:
        s = self.s
        self.need("{")
        while s[self.i] != "}":
            if self.take(K["case"]):
                while True:
                    if not self.take(K["default"]) and not self.attempt(self.pattern_):
                        self.ternary()
                    if not self.take(","):
                        break
                if self.take(K["when"]):
                    self.expr()
            else:
                self.need(K["default"])
            if self.take(ARROW):
                if s[self.i] == "{":
                    self.block()
                elif s[self.i] == K["throw"]:
                    self.statement()
                else:
                    self.expr()
                    self.need(";")
            else:
                self.need(":")
                self.statements("}" + K["case"] + K["default"], self.statement)
        self.i += 1

    def pattern_(self):
        self.modifiers()
        self.type()
        if self.take("("):
            while self.s[self.i] != ")":
                self.pattern_()
                if self.s[self.i] != ")":
                    self.need(",")
            self.i += 1
            if self.s[self.i] in NAMES and self.s[self.i] != K["when"]:
                self.i += 1
            return True
        self.name()
        return True

    def jump(self) -> None:
        c = self.s[self.i]
        self.i += 1
        if c in K["return"] + K["throw"] + K["yield"]:
            if self.s[self.i] != ";" or c != K["return"]:
                end = self.stretch(self.i)
                if end is not None:
                    self.remember("e", end, self.value)
                    return
                self.expr()
        elif self.s[self.i] in NAMES:
            self.i += 1
        self.need(";")

    def value(self) -> None:
        self.expr()
        self.need(";")

    def assert_(self) -> None:
        self.i += 1
        self.expr()
        if self.take(":"):
            self.expr()
        self.need(";")

    # expressions ---------------------------------------------------------------------
    def expr(self) -> None:
        s, at = self.s, self.i
        c = s[at]
        self.was_statement = False
        if c in NAMES and s[at + 1] == ARROW:
            self.i += 2
            self.lambda_body()
            return
        if c == "(":
            e = self.match.get(at)
            if e is not None and s[e + 1] == ARROW:
                if not self.attempt(self.names_only):
                    self.params()
                self.need(ARROW)
                self.lambda_body()
                return
        self.ternary()
        if s[self.i] in ASSIGN:
            if s[self.i - 1] not in NAMES + "])":
                self.fail()
            self.i += 1
            self.expr()
            self.was_statement = True
        else:
            self.was_statement = False

    def names_only(self):
        self.need("(")
        while self.s[self.i] != ")":
            self.name()
            if self.s[self.i] != ")":
                self.need(",")
        self.i += 1
        return True

    def lambda_body(self) -> None:
        if self.s[self.i] == "{":
            self.block()
        else:
            self.expr()

    def ternary(self) -> None:
        self.binary(1)
        if self.take("?"):
            self.expr()
            self.need(":")
            if self.s[self.i] == "(" or self.s[self.i + 1] == ARROW:
                self.expr()
            else:
                self.ternary()

    def binary(self, least: int) -> None:
        s = self.s
        self.unary()
        while True:
            c = s[self.i]
            p = BINARY.get(c)
            if p is None or p < least:
                return
            self.i += 1
            if c == K["instanceof"]:
                if not self.attempt(self.pattern_):
                    self.modifiers()
                    self.type()
                continue
            if c == ">":
                while s[self.i] == ">":
                    self.i += 1
            self.binary(p + 1)

    def unary(self) -> None:
        s = self.s
        while s[self.i] in PREFIX:
            self.i += 1
        if s[self.i] == "(":
            e = self.match.get(self.i)
            if e is not None and s[e + 1] in CAST_NEXT + (PREFIX if s[self.i + 1] in PRIMITIVE else "") and self.attempt(self.cast):
                if s[self.i + 1] == ARROW or s[self.i] == "(":
                    at = self.i
                    e = self.match.get(at)
                    if s[at + 1] == ARROW or e is not None and s[e + 1] == ARROW:
                        self.expr()
                        return
                self.unary()
                return
        self.postfix()
        while s[self.i] in INCDEC:
            self.i += 1

    def cast(self):
        self.need("(")
        self.type()
        while self.take("&"):
            self.type()
        self.need(")")
        return True

    def args(self) -> None:
        self.need("(")
        s = self.s
        if self.take(")"):
            return
        while True:
            m = LITERALS.match(s, self.i)
            if m:
                self.i = m.end()
            self.expr()
            if not self.take(","):
                break
        self.need(")")

    def postfix(self) -> None:
        s = self.s
        c = s[self.i]
        if c in NAMES:
            self.i += 1
            if s[self.i] == "<" and self.attempt(self.generic_ref):
                return self.postfix_rest()
            if s[self.i] == "[" and s[self.i + 1] == "]":
                self.dims()
                if s[self.i] not in "." + REF:
                    self.fail()
        elif c in LITERAL:
            self.i += 1
        elif c == "(":
            self.i += 1
            self.expr()
            self.need(")")
        elif c in THIS + SUPER:
            self.i += 1
        elif c == NEW:
            self.creation()
        elif c in PRIMITIVE or c == K["void"]:
            self.i += 1
            self.dims()
            if s[self.i] not in "." + REF:
                self.fail()
        elif c == K["switch"]:
            self.i += 1
            self.paren()
            self.switch_body()
        else:
            self.fail()
        self.postfix_rest()

    def generic_ref(self):
        self.type_args()
        self.dims()
        while self.take("."):
            self.type()
        return self.s[self.i] == REF or self.fail()

    def postfix_rest(self) -> None:
        s = self.s
        while True:
            c = s[self.i]
            if c == ".":
                self.i += 1
                if s[self.i] == "<":
                    self.type_args()
                if s[self.i] == NEW:
                    self.creation()
                elif s[self.i] in NAMES + THIS + SUPER + CLASS:
                    self.i += 1
                else:
                    self.fail()
            elif c == "(":
                if s[self.i - 1] not in NAMES + THIS + SUPER:
                    self.fail()
                self.group("a", self.args)
            elif c == "[":
                self.i += 1
                self.expr()
                self.need("]")
            elif c == REF:
                self.i += 1
                if s[self.i] == "<":
                    self.type_args()
                if s[self.i] not in NAMES + NEW:
                    self.fail()
                self.i += 1
            else:
                return

    def creation(self) -> None:
        s = self.s
        self.need(NEW)
        while s[self.i] == "@":
            self.annotation()
        if s[self.i] in PRIMITIVE:
            self.i += 1
        else:
            while True:
                self.name()
                if s[self.i] == "<":
                    self.type_args()
                if not self.take("."):
                    break
        if s[self.i] == "(":
            self.args()
            if s[self.i] == "{":
                self.body(-1)
            return
        if s[self.i] != "[":
            self.fail()
        empty = s[self.i + 1] == "]"
        while s[self.i] == "[":
            self.i += 1
            if s[self.i] != "]":
                self.expr()
            self.need("]")
            if not empty and s[self.i] == "[" and s[self.i + 1] == "]":
                self.dims()
                break
        if empty:
            if s[self.i] != "{":
                self.fail()
            self.initializer()


DISPATCH = {K[w]: f for w, f in {"if": Java.if_, "for": Java.for_, "while": Java.while_, "do": Java.do, "switch": Java.switch, "try": Java.try_, "assert": Java.assert_, **dict.fromkeys(words("return throw yield break continue"), Java.jump)}.items()}
