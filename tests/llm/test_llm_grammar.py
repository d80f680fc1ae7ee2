import pytest

from lakelens import grammar as G

GOOD = {
    "py": ["", "x = 1\n", "﻿def f(a, /, *, b=1):\r\n    return a\r\n", "async def f():\n    async with a as b, c:\n        await d\n", "match x:\n    case [1, *r] if r:\n        pass\n    case _:\n        y = f'{a!r:>{w}}{{}}'\n", "class A(B, metaclass=C):\n    x: int = 1\n    def m(self): return self.x if self else lambda y: y\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    del a[1:2, ::3]\n", "print(*a, **k)\nx = [i for i in y if i] + [*z]\n", "if (n := 3) > 2: pass\n", "a = b'x' b'y'\n", "@d(1)\nclass K: ...\n", "return 1\nbreak\n"],
    "js": ["", "#!/usr/bin/env node\nlet a = 1\nlet b = a\n", "const f = async ({a, ...b} = {}, [c = 1]) => { for await (const x of y) z?.[x]?.(1); };", "class A extends B { #p = 1; static { x(); } get y() { return this.#p } async *z() {} }", "x = a ? `t ${b ? `u ${c}` : ''}` : /[/]re\\/g/gi.test(s);", "export default function () {}\nexport { a as b, c } from './m.js';\nimport d, * as e from 'e';", "switch (a) { case 1: default: break; }", "label: for (;;) { continue label }", "if (a) b\nelse c", "var {x, y: {z}} = o, w;", "a = b / c / d;", "new Foo; new (bar())(1);", "try { } catch { } finally { }", "x = {async f() {}, get: 1, [k]: 2, 'q': 3, ...r}"],
    "ts": ["interface A<T extends B = C> extends D { (x: number): string; readonly [k: string]: any; m?(): void }", "type X<T> = T extends infer U ? U[] : keyof T | 'a' & { -readonly [K in keyof T]?: T[K] };", "export abstract class A<T> implements B { private constructor(public x: number, y?: string) { super(); } abstract m(): void; }", "const f = <T,>(a: T): a is string => true;", "enum E { A = 1, B }\ndeclare module 'x' { export function f(a: number): void; }", "let v = <any>x as unknown as string; let w = y!;", "function f(this: Window, ...a: number[]): asserts a is X {}", "const x = a as const;", "let m: Map<string, number[]> = new Map<string, number[]>();"],
    "php": ["", "plain text, no tags", "<?php\nnamespace A\\B;\nuse C\\{D, function e};\nfinal class X extends Y implements Z { use T; const A = 1; private ?int $b = null; public static function f(int|string $a, &...$r): static { return new static; } }", "<?php $a = fn($x) => $x ?? [1, 'k' => 2]; echo <<<EOT\n x $a\n EOT;\n", "<?php foreach ($a as $k => [$b, $c]): ?>html<?php endforeach ?>", "<?php match(true) { 1, 2 => 'a', default => throw new E };", "<?php #[Attr(1)]\nfunction g() { yield 1 => 2; }", "<?php if ($a) : elseif ($b): else: endif;", "<?php $f = function () use (&$x): void { static $y = 1; };", "<?php try { } catch (A | B $e) { } finally { }", "<?php $x = (array) $y; $z = $a?->b::C;"],
    "go": ["package a\n\nimport (\n\t\"x\"\n\ty \"z\"\n)\n\nfunc (r *R[T]) M(a, b int, c ...string) (n int, err error) {\n\tif v, ok := m[k]; ok && v != nil {\n\t\treturn\n\t}\n\tfor i := range 10 {\n\t\tgo func() { ch <- i }()\n\t}\n\tswitch x := y.(type) {\n\tcase int, string:\n\tdefault:\n\t}\n\tselect {\n\tcase <-c:\n\t}\n\treturn 0, nil\n}\n", "package a\ntype G[T any] struct {\n\tA int `json:\"a\"`\n\t*B\n}\nvar x = map[string][]int{\"a\": {1, 2}}\n", "package a\nfunc F[T ~int | string](x T) T { L: for { break L }; return x }\n"],
    "java": ["package a.b;\nimport static x.Y.*;\n@A(v = {1, 2}) public sealed class K<T extends Comparable<? super T>> extends L implements M permits N { int[] a = {1, 2}; static { } K(int... x) throws E { this(1); } <U> U f(final U u) { for (var x : y) { if (x instanceof String s && !s.isEmpty()) { } } return (U) u; } }", "record P(int x, int y) { P { } }", "enum E implements I { A(1) { void f() { } }, B; E(int x) { } E() { } }", "interface I { default void f() { Runnable r = () -> { }; Function<A, B> g = A::new; int x = switch (y) { case 1, 2 -> 3; default -> { yield 4; } }; } void g(); }", "class A { void f() { try (var r = new R()) { } catch (A | B e) { } String t = \"\"\"\n  x\"y\n  \"\"\"; char c = '\\u0041'; a.b[1].c(d, e -> e + 1)++; int[][] z = new int[3][]; } }"],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u0041"]}', "[]", '"x"', "  3 "],
}
BAD = {
    "py": ["def f(:\n  pass\n", "x = (1\n", "<<<<<<< HEAD\nx = 1\n", "if a\n  b\n", "def f():\npass\n", "x = 'abc\n", "  x = 1\ny = 2\n", "f(a=1, 2)\n", "x = 01\n", "class :\n  pass\n"],
    "js": ["function f( { }", "let a = ;", "a b c", "if (a { b }", "const x;", "<<<<<<< HEAD", "x = 'abc", "x = `a ${b`", "foo(1, 2", "class A { m( { } }", "try { }", "interface A { x: number }", "a = 1 +", "import x y"],
    "ts": ["interface A { x: ", "type X = ;", "let a: = 1", "function f(a: number { }", "enum E { A = }"],
    "php": ["<?php function f( { }", "<?php $a = ;", "<?php if ($a { }", "<?php class { }", "<?php echo 'a", "<?php foo(1", "<?php } ", "<?php $a b;", "<?php const x = (a) => { return a; };"],
    "go": ["func f() {}", "package a\nfunc f( {\n}\n", "package a\nfunc f() {\n", "package a\nvar x = \n", "package a\n}\n", "package a\nfunc f() { if { } }\n"],
    "java": ["class A { void f( { } }", "class A { int x = ; }", "class A { void f() { x + 1; } }", "class A {", "class A { } }", "function f() { }", "class A { String s = \"abc; }"],
    "json": ["{'a': 1}", "[1,]", '{"a" 1}', "01", "// c\n{}", "{", "NaN", "[1 2]", ""],
}


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, all_ in GOOD.items() for t in all_])
def test_accepts(ext, text):
    p = G.parse(ext, text)
    assert not p.errors, [(p.line(a), w) for a, w in p.errors]


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, all_ in BAD.items() for t in all_])
def test_rejects(ext, text):
    p = G.parse(ext, text)
    assert p.errors
    assert all(p.line(a) >= 1 and w for a, w in p.errors)


@pytest.mark.parametrize("ext", ["js", "php", "go", "java", "py"])
def test_goes_on_after_an_error(ext):
    text = {"js": "a = ;\nb = 1;\nc = ;", "php": "<?php $a = ;\n$b = 1;\n$c = ;", "go": "package a\nfunc f() {\n\ta := \n\tb := 1\n\tc := )\n}\n", "java": "class A { void f() { a = ; b = 1; c = ; } }", "py": "a = \nb = 1\nc = \n"}[ext]
    assert len(G.parse(ext, text).errors) == 2


@pytest.mark.parametrize("ext", list(GOOD))
def test_memo_changes_nothing(ext):
    first = [bool(G.parse(ext, t).errors) for t in GOOD[ext] + BAD.get(ext, [])]
    assert first == [bool(G.parse(ext, t).errors) for t in GOOD[ext] + BAD.get(ext, [])]


@pytest.mark.parametrize(("ext", "text"), [("json", "[" * 100_000 + "]" * 100_000), ("js", "(" * 50_000 + "1" + ")" * 50_000), ("py", "x = " + "(" * 50_000 + "1" + ")" * 50_000)])
def test_very_deep(ext, text):
    G.parse(ext, text)


def test_very_long():
    assert not G.parse("js", "x = [" + "1, " * 300_000 + "2];").errors


@pytest.mark.parametrize(("path", "ext"), [("a/b.PY", "py"), ("a.b/c", ""), (None, ""), ("x.", ""), (".env", "env")])
def test_extension(path, ext):
    assert G.extension(path) == ext


@pytest.mark.parametrize("ext", ["js", "ts", "php", "java", "go"])
def test_errors_inside_are_never_remembered(ext):
    """A statement that holds a broken one is found broken each time it is met."""
    text = {"js": "f(function () { a = ; });", "ts": "f(function () { a = ; });", "php": "<?php f(function () { $a = ; });", "java": "class A { void g() { f(() -> { a = ; }); } }", "go": "package a\nfunc g() {\n\tf(func() { a = })\n}\n"}[ext]
    assert [bool(G.parse(ext, text).errors) for _ in range(3)] == [True] * 3
