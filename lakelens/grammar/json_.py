"""Strict JSON."""

from __future__ import annotations

import re

from .core import BAD, EOF, NUM, STR, Classes, Parser, words

PATTERN = re.compile(r'[ \t\r\n﻿]+|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![0-9])|[A-Za-z_]+|[\s\S]')
RUN = re.compile(r'(?:["0l],)+')
PAIRS = re.compile(r'(?:":["0l],)+')


def classify(tok: str) -> str:
    c = tok[0]
    if c in " \t\r\n﻿":
        return ""
    if c == '"' and len(tok) > 1:
        return STR
    if c == "-" and len(tok) > 1 or c.isdigit():
        return NUM
    if tok in ("true", "false", "null"):
        return "l"
    return BAD


CLASSES = Classes(words("{ } [ ] : ,"), classify)


class Json(Parser):
    classes, pattern, memo = CLASSES, PATTERN, {}
    sync = ","

    def program(self) -> None:
        try:
            self.value()
            if self.s[self.i] != EOF:
                self.fail()
        except Exception as e:
            if not hasattr(e, "what"):
                raise
            self.errors.append((e.at, e.what))
            self.i = len(self.s) - 1

    def value(self) -> None:
        s = self.s
        c = s[self.i]
        if c in '"0l':
            self.i += 1
        elif c == "[":
            self.i += 1
            if self.take("]"):
                return
            while True:
                m = RUN.match(s, self.i)
                if m:
                    self.i = m.end()
                self.value()
                if not self.take(","):
                    break
            self.need("]")
        elif c == "{":
            self.i += 1
            if self.take("}"):
                return
            while True:
                m = PAIRS.match(s, self.i)
                if m:
                    self.i = m.end()
                self.need(STR)
                self.need(":")
                self.value()
                if not self.take(","):
                    break
            self.need("}")
        else:
            self.fail()
