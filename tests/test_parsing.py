"""Calls, symbols of all languages and short names, on small files."""

from lakelens.operators import parsing

SCHEMA = "snapshot_id long, repo_id string, file_path string, content string"
PY = '''import os
LIMIT = load(3)
os.path.join("a", f(1))


@decorated(1)
def top(x=default()):
    inner(x.y(2))

    def nested():
        return deep()


class K(Base, metaclass=M):
    """Doc of K."""
    size = field()

    def run(self):
        self.go()[0].stop()

    @property
    def held(self):
        return missed()
'''


def test_calls_with_their_callers(spark):
    rows = [(1, "r", "a.py", PY), (2, "r", "b.py", "def f(:\n"), (3, "r", "c.py", None), (4, "r", "d.js", "f()")]
    got = [(r.snapshot_id, r.line_no, r.caller, r.callee) for r in parsing.python_calls(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = [
        (2, "a.py:module", "load"), (3, "a.py:module", "os.path.join"), (3, "a.py:module", "f"), (6, "a.py:module", "decorated"), (8, "a.py:top", "inner"), (8, "a.py:top", "x.y"), (11, "a.py:nested", "deep"),
        (19, "a.py:K.run", "self.go()[0].stop"), (19, "a.py:K.run", "self.go"),
    ]
    assert sorted(got) == sorted((1, *w) for w in want)


def test_symbols_of_all_languages(spark):
    rows = [
        (1, "r", "a.js", "const load = async (a, b) => {\n  return a;\n};\nclass Q {\n  run(x) { return x; }\n}\nfunction top() {}\n"), (2, "r", "b.go", "package p\n\nfunc (m *Msg) Get() string {\n\treturn m.v\n}\n"),
        (3, "r", "c.php", "<?php\nclass A {\n  public function go(int $x): int { return $x; }\n}\n"), (4, "r", "d.java", "class B {\n  int n() { return 1; }\n}\n"), (5, "r", "e.ts", "function f(a: number {\n"), (6, "r", "f.py", ""), (7, "r", "g.md", "x"), (8, "r", None, "x"),
    ]
    got = [(r.snapshot_id, r.kind, r.name, r.line_start, r.line_end) for r in parsing.repository_symbols(spark.createDataFrame(rows, SCHEMA)).collect() if r.error is None]
    assert [(g[0], g[2], g[3], g[4]) for g in sorted(got)] == sorted([(1, "load", 1, 3), (1, "run", 5, 5), (1, "top", 7, 7), (2, "Get", 3, 5), (3, "go", 3, 3), (4, "n", 2, 2)], key=lambda g: [x for x in sorted(got) if (x[0], x[2], x[3], x[4]) == g][0])
    errors = [(r.snapshot_id, r.line_start) for r in parsing.repository_symbols(spark.createDataFrame(rows, SCHEMA)).collect() if r.error]
    assert errors == [(5, 1)]


def test_short_names_and_their_fallback(spark):
    rows = [(1, "r", "a.py", PY), (2, "r", "b.py", "class A:\n    def m(self):\n        pass\n\ndef f(:\n    pass\n"), (3, "r", "c.py", None)]
    got = {(r.snapshot_id, r.name): r for r in parsing.python_outline_short(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k for k in got if k[0] == 1} == {(1, "LIMIT"), (1, "top"), (1, "K"), (1, "K.run"), (1, "K.held")}
    k = got[1, "K"]
    assert (k.signature, k.docstring, k.children, k.is_fallback) == ("class K(Base)", "Doc of K.", ["run", "held"], False) and got[1, "LIMIT"].kind == "variable"
    assert {k: (r.kind, r.parent) for k, r in got.items() if k[0] == 2} == {(2, "A"): ("class", None), (2, "A.m"): ("method", "A"), (2, "f"): ("function", None)} and got[2, "f"].is_fallback
