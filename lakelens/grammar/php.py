"""PHP. Text outside the tags is output and always valid."""

from __future__ import annotations

import re

from .core import BAD, EOF, ID, LITERALS, NUM, STR, Classes, Func, Parser, words

# fixed values: reserved words and operators of PHP
KEYWORDS = words("abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield enum from self parent exit die eval")
SOFT = words("enum from self parent readonly match")
OPERATORS = words("=> -> ?-> :: ?? ??= ** **= ++ -- && || == === != !== <> <= >= <=> << >> += -= *= /= .= %= &= |= ^= <<= >>= ... = < > + - * / % & | ^ ! ~ ? : ; , . ( ) [ ] { } @ # \\ #[ $")
NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[bB][01](?:_?[01])*|0[oO]?(?:_?[0-7])+|(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9]+)?)\Z")
PATTERN = re.compile(
    r"\s+|//(?:(?!\?>)[^\n])*|#(?!\[)(?:(?!\?>)[^\n])*|/\*(?:[^*]|\*(?!/))*\*/|/\*"
    r"|<<<[ \t]*(?P<q>[\"']?)(?P<tag>[^\W\d]\w*)(?P=q)\r?\n(?:[\s\S]*?\n)??[ \t]*(?P=tag)\b"
    r"|\$?[^\W\d]\w*|\.?[0-9](?:[\w.]|(?<=[eE])[+-](?=[0-9]))*"
    r"|'(?:[^'\\]|\\[\s\S])*'|\"(?:[^\"\\]|\\[\s\S])*\"|`(?:[^`\\]|\\[\s\S])*`"
    r"|\?->|\?\?=|<=>|\*\*=|\.\.\.|===|!==|<<=|>>=|=>|->|::|\?\?|\*\*|\+\+|--|&&|\|\||==|!=|<>|<=|>=|<<|>>|[+\-*/.%&|^]=|#\[|\?>|[\s\S]"
)
TAG = re.compile(r"<\?(?:php(?=\s|\Z)|=)", re.I)
VAR = "v"


def classify(tok: str) -> str:
    c = tok[0]
    if c.isspace() or c == "﻿" or tok.startswith("//") or c == "#" and tok != "#[":
        return ""
    if tok.startswith("/*"):
        return "" if len(tok) > 3 else BAD
    if c == "$":
        return VAR if len(tok) > 1 else "$"
    if c.isalpha() or c == "_":
        return FIXED.get(tok.lower(), ID)
    if c.isdigit() or c == "." and len(tok) > 1:
        return NUM if NUMBER.match(tok) else BAD
    if c in "\"'`" and len(tok) > 1 or tok.startswith("<<<"):
        return STR
    if tok == "?>":
        return ";"
    return BAD


CLASSES = Classes(KEYWORDS + OPERATORS, classify)
FIXED = K = CLASSES.fixed
KEY = "".join(K[w] for w in KEYWORDS)
SELF = "".join(K[w] for w in SOFT)
NAMES = ID + SELF
WORDS = ID + KEY
BINARY = {K[o]: p for p, row in enumerate(["or", "xor", "and", "??", "||", "&&", "|", "^", "&", "== != === !== <> <=>", "< <= > >=", ".", "<< >>", "+ -", "* / %", "instanceof", "**"], 1) for o in row.split()}
ASSIGN = "".join(K[o] for o in words("= += -= *= /= .= %= **= &= |= ^= <<= >>= ??="))
PREFIX = "+-!~@&" + "".join(K[w] for w in words("++ -- clone print include include_once require require_once"))
INCDEC = K["++"] + K["--"]
ARROW, FAT, SCOPE, SAFE, DOTS, FN, FUNCTION, STATIC, NEW, ATTR = (K[w] for w in words("-> => :: ?-> ... fn function static new #["))
MODS = "".join(K[w] for w in words("public protected private static abstract final readonly var"))
CASTS = {"int", "integer", "bool", "boolean", "float", "double", "real", "string", "array", "object", "unset", "binary"}


class Php(Parser):
    classes, pattern, memo = CLASSES, PATTERN, {}

    def lex(self) -> None:
        """Parts outside the tags become one blank token each."""
        text, at, toks, codes = self.text, 0, [], []
        find = self.pattern.finditer
        while at < len(text):
            m = TAG.search(text, at)
            if m is None:
                toks.append(text[at:])
                codes.append("")
                break
            toks.append(text[at : m.end()])
            codes.append(K["echo"] if m.group().endswith("=") else "")
            at, n = m.end(), len(toks)
            close = text.find("?>", at)
            if close < 0:
                toks += [x.group() for x in find(text, at)] if "<<<" in text else self.quick(text, at)
                at = len(text)
            else:
                for x in find(text, at):
                    toks.append(x.group())
                    at = x.end()
                    if toks[-1] == "?>":
                        break
            codes += map(self.classes.__getitem__, toks[n:])
        self.toks, self.codes = toks, codes
        self.s = "".join(codes)

    def quick(self, text: str, at: int) -> list[str]:
        return QUICK.findall(text, at)

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

    def end(self) -> None:
        if self.s[self.i] != EOF or not self.text.rstrip().endswith("?>"):
            self.need(";")

    def name(self) -> None:
        s = self.s
        self.take("\\")
        if s[self.i] not in NAMES + K["namespace"]:
            self.fail()
        self.i += 1
        while s[self.i] == "\\":
            self.i += 1
            if s[self.i] not in WORDS:
                self.fail()
            self.i += 1

    def attributes(self) -> None:
        while self.take(ATTR):
            while self.s[self.i] != "]":
                self.name()
                if self.s[self.i] == "(":
                    self.args()
                if self.s[self.i] != "]":
                    self.need(",")
            self.i += 1

    def statement(self) -> None:
        s, i = self.s, self.i
        c = s[i]
        f = DISPATCH.get(c)
        if f is not None:
            f(self)
        elif c == ";":
            self.i += 1
        elif c == "{":
            self.block()
        elif c == ATTR:
            self.attributes()
            if s[self.i] not in MODS + FUNCTION + FN + "".join(K[w] for w in words("class interface trait enum")):
                self.fail()
            self.statement()
        elif c == STATIC and s[i + 1] == VAR:
            self.i += 1
            self.var_list()
        elif c == K["enum"] and s[i + 1] == ID:
            self.class_()
        elif c == K["readonly"] and s[i + 1] in (K["class"], K["final"], K["abstract"]):
            self.class_()
        elif c == ID and s[i + 1] == ":" and s[i + 2] != ":":
            self.i += 2
        else:
            end = self.stretch(i)
            if end is None:
                self.expr_end()
            else:
                self.remember("s", end, self.expr_end)

    def expr_end(self) -> None:
        self.expr()
        self.end()

    def var_list(self) -> None:
        while True:
            self.need(VAR)
            if self.take("="):
                self.expr()
            if not self.take(","):
                break
        self.end()

    def namespace(self) -> None:
        if self.s[self.i + 1] == "\\":
            self.expr_end()
            return
        self.i += 1
        if self.s[self.i] != "{":
            self.name()
        if self.s[self.i] == "{":
            self.block()
        else:
            self.end()

    def use(self) -> None:
        s = self.s
        self.i += 1
        if s[self.i] in (FUNCTION, K["const"]):
            self.i += 1
        while True:
            self.use_name()
            if not self.take(","):
                break
        self.end()

    def use_name(self) -> None:
        s = self.s
        self.take("\\")
        if s[self.i] not in NAMES:
            self.fail()
        self.i += 1
        while self.take("\\"):
            if self.take("{"):
                while s[self.i] != "}":
                    if s[self.i] in (FUNCTION, K["const"]):
                        self.i += 1
                    self.use_name()
                    if s[self.i] != "}":
                        self.need(",")
                self.i += 1
                return
            if s[self.i] not in WORDS:
                self.fail()
            self.i += 1
        if self.take(K["as"]):
            self.name()

    def const(self) -> None:
        self.i += 1
        if self.s[self.i] in NAMES + "?\\" + K["array"] and self.s[self.i + 1] != "=":
            self.type()
        while True:
            if self.s[self.i] not in WORDS:
                self.fail()
            self.i += 1
            self.need("=")
            self.expr()
            if not self.take(","):
                break
        self.end()

    def function(self) -> None:
        s, start = self.s, self.i
        k = start + 1 + (s[start + 1] == "&")
        if s[k] == "(":
            self.expr_end()
            return
        self.i = k
        name = self.i
        if s[name] not in WORDS:
            self.fail()
        self.i += 1
        self.signature()
        head = self.i
        self.block()
        while start and s[start - 1] == "]" and self.attribute_start(start - 1) is not None:
            start = self.attribute_start(start - 1)
        self.funcs.append(Func(start, name, head, self.i))

    def attribute_start(self, close: int):
        depth = 0
        for k in range(close, -1, -1):
            c = self.s[k]
            depth += (c == "]") - (c in "[" + ATTR)
            if depth == 0:
                return k if c == ATTR else None
        return None

    def signature(self) -> None:
        if self.s[self.i] != "(":
            self.fail()
        self.group("p", self.params)
        if self.take(":"):
            self.type()

    def params(self) -> None:
        s = self.s
        self.need("(")
        while s[self.i] != ")":
            self.attributes()
            while s[self.i] in MODS:
                self.i += 1
            if s[self.i] not in "&" + VAR + DOTS:
                self.type()
            self.take("&")
            self.take(DOTS)
            self.need(VAR)
            if self.take("="):
                self.expr()
            if s[self.i] != ")":
                self.need(",")
        self.i += 1

    def type(self) -> None:
        s = self.s
        self.take("?")
        while True:
            if self.take("("):
                self.type()
                self.need(")")
            elif s[self.i] in K["array"] + K["callable"] + STATIC:
                self.i += 1
            else:
                self.name()
            if s[self.i] == "|" or s[self.i] == "&" and s[self.i + 1] not in VAR + DOTS + "&":
                self.i += 1
            else:
                return

    def class_(self) -> None:
        s, i = self.s, self.i
        while s[self.i] in K["abstract"] + K["final"] + K["readonly"]:
            self.i += 1
        kind = s[self.i]
        if kind not in "".join(K[w] for w in words("class interface trait enum")):
            self.fail()
        self.i += 1
        if s[self.i] not in NAMES:
            self.fail()
        owner = self.i
        self.i += 1
        if kind == K["enum"] and self.take(":"):
            self.type()
        self.class_rest(owner)

    def class_rest(self, owner: int) -> None:
        if self.take(K["extends"]):
            self.name_list()
        if self.take(K["implements"]):
            self.name_list()
        self.need("{")
        before, self.owner = getattr(self, "owner", -1), owner
        self.statements("}", self.member)
        self.owner = before
        self.need("}")

    def name_list(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def member(self) -> None:
        s, start = self.s, self.i
        self.attributes()
        if self.take(K["use"]):
            self.name_list()
            if self.take("{"):
                while s[self.i] != "}":
                    self.name()
                    if self.take(SCOPE):
                        self.i += 1
                    if not self.take(K["insteadof"]):
                        self.need(K["as"])
                        while s[self.i] in MODS:
                            self.i += 1
                        if s[self.i] in WORDS:
                            self.i += 1
                    else:
                        self.name_list()
                    self.need(";")
                self.i += 1
            else:
                self.end()
            return
        if self.take(K["case"]):
            if s[self.i] not in WORDS:
                self.fail()
            self.i += 1
            if self.take("="):
                self.expr()
            self.need(";")
            return
        n = self.i
        while s[self.i] in MODS:
            self.i += 1
        if s[self.i] == K["const"]:
            self.const()
        elif s[self.i] == FUNCTION:
            self.i += 1
            self.take("&")
            name = self.i
            if s[name] not in WORDS:
                self.fail()
            self.i += 1
            self.signature()
            head = self.i
            if not self.take(";"):
                self.block()
            self.funcs.append(Func(start, name, head, self.i, kind="method", owner=self.owner))
        else:
            if n == self.i:
                self.fail()
            if s[self.i] != VAR:
                self.type()
            self.var_list()

    # control -----------------------------------------------------------------------
    def body(self, *closers: str) -> None:
        if self.take(":"):
            ends = "".join(K[w] for w in closers)
            self.statements(ends + "}", self.statement)
            return
        self.statement()

    def if_(self) -> None:
        s = self.s
        self.i += 1
        self.group("c", self.paren)
        if self.take(":"):
            ends = "".join(K[w] for w in words("elseif else endif"))
            while True:
                self.statements(ends + "}", self.statement)
                if self.take(K["elseif"]):
                    self.paren()
                    self.need(":")
                elif s[self.i] == K["else"] and s[self.i + 1] == K["if"]:
                    self.i += 2
                    self.paren()
                    self.need(":")
                elif self.take(K["else"]):
                    self.need(":")
                else:
                    break
            self.need(K["endif"])
            self.end()
            return
        self.statement()
        while self.take(K["elseif"]):
            self.group("c", self.paren)
            self.statement()
        if self.take(K["else"]):
            self.statement()

    def loop(self, close: str) -> None:
        if self.take(":"):
            self.statements(K[close] + "}", self.statement)
            self.need(K[close])
            self.end()
        else:
            self.statement()

    def while_(self) -> None:
        self.i += 1
        self.group("c", self.paren)
        self.loop("endwhile")

    def do(self) -> None:
        self.i += 1
        self.statement()
        self.need(K["while"])
        self.group("c", self.paren)
        self.end()

    def for_(self) -> None:
        self.i += 1
        if self.s[self.i] != "(":
            self.fail()
        self.group("f", self.for_head)
        self.loop("endfor")

    def for_head(self) -> None:
        self.need("(")
        for close in ";;)":
            if self.s[self.i] != close:
                self.expr()
                while self.take(","):
                    self.expr()
            self.need(close)

    def foreach(self) -> None:
        self.i += 1
        if self.s[self.i] != "(":
            self.fail()
        self.group("e", self.foreach_head)
        self.loop("endforeach")

    def foreach_head(self) -> None:
        self.need("(")
        self.expr()
        self.need(K["as"])
        self.expr()
        if self.take(FAT):
            self.expr()
        self.need(")")

    def switch(self) -> None:
        s = self.s
        self.i += 1
        self.group("c", self.paren)
        close = "}"
        if self.take(":"):
            close = K["endswitch"]
        else:
            self.need("{")
        self.take(";")
        while s[self.i] != close:
            if self.take(K["case"]):
                self.expr()
            else:
                self.need(K["default"])
            if not self.take(":"):
                self.need(";")
            self.statements("}" + K["case"] + K["default"] + close, self.statement)
        self.i += 1
        if close != "}":
            self.end()

    def try_(self) -> None:
        self.i += 1
        self.block()
        seen = False
        while self.take(K["catch"]):
            seen = True
            self.need("(")
            self.name()
            while self.take("|"):
                self.name()
            self.take(VAR)
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
        if c == K["goto"]:
            self.need(ID)
        elif self.s[self.i] not in ";" + EOF:
            end = self.stretch(self.i)
            if end is not None and c != K["echo"]:
                self.remember("s", end, self.expr_end)
                return
            self.expr()
            while c == K["echo"] and self.take(","):
                self.expr()
        elif c in K["echo"]:
            self.fail()
        self.end()

    def global_(self) -> None:
        self.i += 1
        self.need(VAR)
        while self.take(","):
            self.need(VAR)
        self.end()

    def declare(self) -> None:
        self.i += 1
        self.args()
        if not self.take(";"):
            self.statement()

    # expressions ---------------------------------------------------------------------
    def expr(self) -> None:
        self.binary(1)

    def binary(self, least: int) -> None:
        s = self.s
        self.unary()
        while True:
            c = s[self.i]
            if c in ASSIGN:
                if s[self.i - 1] not in VAR + "]})" + WORDS:
                    self.fail()
                self.i += 1
                self.take("&")
                self.binary(4)
                continue
            if c == "?":
                if least > 4:
                    return
                self.i += 1
                if not self.take(":"):
                    self.binary(4)
                    self.need(":")
                self.binary(5)
                continue
            p = BINARY.get(c)
            if p is None or p < least:
                return
            self.i += 1
            self.binary(p + (c not in (K["**"], K["??"])))

    def unary(self) -> None:
        s = self.s
        c = s[self.i]
        if c in PREFIX:
            self.i += 1
            self.unary()
            return
        if c == K["throw"]:
            self.i += 1
            self.expr()
            return
        if c == K["yield"]:
            self.i += 1
            if self.take(K["from"]):
                self.expr()
            elif s[self.i] not in ";),]":
                self.expr()
                if self.take(FAT):
                    self.expr()
            return
        if c == "(" and s[self.i + 2] == ")" and s[self.i + 1] in ID + K["array"] + K["unset"] and s[self.i + 3] not in ";,).=" and self.is_cast():
            self.i += 3
            self.unary()
            return
        self.postfix()
        if s[self.i] in INCDEC:
            self.i += 1

    def is_cast(self) -> bool:
        starts, ends = self.positions()
        return self.text[starts[self.i + 1] : ends[self.i + 1]].lower() in CASTS

    def args(self) -> None:
        s = self.s
        self.need("(")
        while s[self.i] != ")":
            m = LITERALS.match(s, self.i)
            if m:
                self.i = m.end()
                continue
            if s[self.i] == DOTS and s[self.i + 1] == ")":
                self.i += 1
                break
            self.take(DOTS)
            if s[self.i] in WORDS and s[self.i + 1] == ":" and s[self.i + 2] != ":":
                self.i += 2
            self.expr()
            if s[self.i] != ")":
                self.need(",")
        self.need(")")

    def array(self, close: str) -> None:
        s = self.s
        while s[self.i] != close:
            m = LITERALS.match(s, self.i)
            if m:
                self.i = m.end()
                continue
            if self.take(","):
                continue
            self.take(DOTS)
            self.expr()
            if self.take(FAT):
                self.expr()
            if s[self.i] != close:
                self.need(",")
        self.i += 1

    def postfix(self) -> None:
        s = self.s
        c = s[self.i]
        if c in VAR + NUM + STR:
            self.i += 1
        elif c == "$":
            while self.take("$"):
                pass
            if self.take("{"):
                self.expr()
                self.need("}")
            else:
                self.need(VAR)
        elif c == "(":
            self.i += 1
            self.expr()
            self.need(")")
        elif c == "[":
            self.i += 1
            self.array("]")
        elif c in K["array"] + K["list"] and s[self.i + 1] == "(":
            self.i += 2
            self.array(")")
        elif c in K["isset"] + K["unset"] + K["empty"] + K["eval"]:
            self.i += 1
            self.args()
        elif c in K["exit"] + K["die"]:
            self.i += 1
        elif c == NEW:
            self.new()
        elif c == STATIC and s[self.i + 1] in FUNCTION + FN:
            self.i += 1
            self.closure()
        elif c in FUNCTION + FN:
            self.closure()
        elif c == ATTR:
            self.attributes()
            self.closure()
        elif c == K["match"] and s[self.i + 1] == "(":
            self.match_()
        elif c in NAMES + "\\" + STATIC + K["namespace"]:
            if c == STATIC:
                self.i += 1
            else:
                self.name()
        else:
            self.fail()
        while True:
            c = s[self.i]
            if c == "(":
                self.group("a", self.args)
            elif c in ARROW + SAFE:
                self.i += 1
                if s[self.i] in WORDS + VAR:
                    self.i += 1
                elif self.take("{"):
                    self.expr()
                    self.need("}")
                else:
                    self.fail()
            elif c == SCOPE:
                self.i += 1
                if s[self.i] in WORDS + VAR:
                    self.i += 1
                elif self.take("{"):
                    self.expr()
                    self.need("}")
                elif s[self.i] == "$":
                    self.i += 1
                    self.need(VAR)
                else:
                    self.fail()
            elif c == "[":
                self.i += 1
                if not self.take("]"):
                    self.expr()
                    self.need("]")
            else:
                return

    def new(self) -> None:
        s = self.s
        self.i += 1
        self.attributes()
        if s[self.i] == K["class"] or s[self.i] == K["readonly"] and s[self.i + 1] == K["class"]:
            self.take(K["readonly"])
            self.i += 1
            if s[self.i] == "(":
                self.args()
            self.class_rest(-1)
            return
        if s[self.i] == VAR:
            self.i += 1
            while s[self.i] in ARROW + SCOPE:
                self.i += 2
        elif s[self.i] == "(":
            self.paren()
        elif not self.take(STATIC):
            self.name()
        if s[self.i] == "(":
            self.args()

    def closure(self) -> None:
        c = self.s[self.i]
        if c not in FUNCTION + FN:
            self.fail()
        self.i += 1
        self.take("&")
        self.need_paren()
        if c == FN:
            if self.take(":"):
                self.type()
            self.need(FAT)
            self.expr()
            return
        if self.take(K["use"]):
            self.need("(")
            while self.s[self.i] != ")":
                self.take("&")
                self.need(VAR)
                if self.s[self.i] != ")":
                    self.need(",")
            self.i += 1
        if self.take(":"):
            self.type()
        self.block()

    def need_paren(self) -> None:
        if self.s[self.i] != "(":
            self.fail()
        self.group("p", self.params)

    def match_(self) -> None:
        self.i += 1
        self.paren()
        self.need("{")
        while self.s[self.i] != "}":
            if not (self.s[self.i] == K["default"] and self.take(K["default"])):
                self.expr()
                while self.take(","):
                    if self.s[self.i] == FAT:
                        break
                    self.expr()
            self.need(FAT)
            self.expr()
            if self.s[self.i] != "}":
                self.need(",")
        self.i += 1


QUICK = re.compile(PATTERN.pattern.replace(r"""|<<<[ \t]*(?P<q>["']?)(?P<tag>[^\W\d]\w*)(?P=q)\r?\n(?:[\s\S]*?\n)??[ \t]*(?P=tag)\b""", "").replace(r"""|<<<[ \t]*(?P<q>[\"']?)(?P<tag>[^\W\d]\w*)(?P=q)\r?\n(?:[\s\S]*?\n)??[ \t]*(?P=tag)\b""", ""))

DISPATCH = {K[w]: f for w, f in {"namespace": Php.namespace, "use": Php.use, "const": Php.const, "function": Php.function, "if": Php.if_, "while": Php.while_, "do": Php.do, "for": Php.for_, "foreach": Php.foreach, "switch": Php.switch, "try": Php.try_, "global": Php.global_, "declare": Php.declare, **dict.fromkeys(words("class interface trait abstract final"), Php.class_), **dict.fromkeys(words("return echo break continue goto"), Php.jump)}.items()}
