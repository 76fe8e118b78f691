import pytest

from treeline.parsers.grammar import parses

VALID = {
    "c": [
        "", "int x;", '#include <a.h>\n#define M(x) \\\n  (x)\nint f(int a, char *b[3]) { if (a) return 1; else if (b) { a++; } else a = 2; for (int i = 0; i < 3; i++) ; while (a--) { } do { a = 1; } while (a); switch (a) { case 1: break; default: return 0; } return (int) a + sizeof(int); }',
        "struct p { int x; unsigned y : 3; struct p *next; } q = { .x = 1, .y = 2 };\nenum e { A, B = 2, };\ntypedef struct { int a; } t;", "static const char *s[] = { \"a\" \"b\", \"c\" };", "int (*fp)(int, void *);", "void g(void) { x: goto x; t *p = (t *) h(1, 2); p->a.b[1] = ~3; foo(a, b)->c(d); }",
        "int f(void) { /* <<<<<<< */ return 'a'; }", "extern \"C\" { int f(int); }",
    ],
    "go": [
        "package a\n", 'package a\n\nimport (\n\t"fmt"\n\tx "os"\n)\n\nconst A, B = 1, 2\n\ntype S struct {\n\tA, B int `json:"a"`\n\t*T\n}\n\ntype I interface {\n\tF(a int) (int, error)\n}\n\nfunc (s *S) F(a int, b ...string) (n int, err error) {\n\tif x := g(); x > 0 {\n\t\treturn 1, nil\n\t} else if y {\n\t} else {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor k, v := range m {\n\t\t_ = k\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tswitch t := v.(type) {\n\tcase int, string:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase <-c:\n\t}\n\tgo func() { x() }()\n\tdefer f()\n\tp := &S{A: 1, B: 2}\n\tq := []int{1, 2, 3}\n\tr := map[string]S{"a": {A: 1}}\n\tc <- 1\n\treturn\n}\n',
        "package a\nfunc M[T any, K int | string](x T) T { return x }\n", "package a\n/* x\n y */ var z = `raw\n`\n",
    ],
    "java": [
        "package a.b;\nimport java.util.*;\nimport static a.B.c;\n@Deprecated public final class A<T extends B & C> extends D<T> implements E, F<G<H>> { private static final int X = 1, y[] = {1, 2}; static { x(); } A(int a) throws E { super(a); } @Override public <U> List<U> m(final int... a) { for (String s : list) { continue; } for (int i = 0, j = 1; i < 2; i++, j--) x(); try (R r = o(); S s = p()) { } catch (A | B e) { throw e; } finally { } switch (a) { case 1: case 2: break; default: } int z = switch (a) { case 1, 2 -> 3; default -> { yield 4; } }; Runnable r = () -> { }; f(x -> x + 1, A::new, int[]::new); int[] q = new int[3], w = new int[] {1}; synchronized (this) { } label: while (true) { break label; } do x++; while (x < 3); assert x > 1 : \"m\"; Object o = (String) y; if (o instanceof String s && !s.isEmpty()) { return null; } else return (a) -> b; } enum K { A(1) { void f() {} }, B; int v; } interface L { void f(); default int g() { return 1; } } record P(int a, String b) { } }",
        "class A { List<Map<String, List<Integer>>> x = new ArrayList<>(); String t = \"\"\"\n a \"b\"\n\"\"\"; char c = '\\''; }", "/* <<<<<<< */ class A { }",
    ],
    "js": [
        "", "let a = 1\nconst b = [1, , ...c]\nvar {x, y: [z] = 2, ...r} = o", "function f(a, {b}, ...c) { if (a) return\nelse if (b) { } else c()\nfor (let i = 0; i < 3; i++) ;\nfor (const k of x) { }\nfor (k in y) z()\nwhile (a) b--\ndo { } while (x)\nswitch (a) { case 1: case 'b': break; default: x() } try { } catch { } finally { } throw new Error('x') }",
        "class A extends B { static x = 1; #p; constructor() { super() } get a() { return 1 } async *g() { yield* h() } static { } [k]() { } }", "const f = async (a, b = 2) => { await x }, g = x => ({ y: x }), h = function* () { }", "a?.b?.[c]?.(d) ?? e; x = /ab\"c[/]/g.test(s) ? `t${a + `n`}` : !function () { }()",
        "import d, { a as b } from 'm'\nimport * as n from \"n\"\nexport default class { }\nexport const z = 1\nexport { a, b as c }\nexport * from 'x'", "label: for (;;) { break label }\nnew Foo\nnew a.b.C(1)\ndelete o.x, void 0, typeof y", "(() => { })()\n;[1].map(x => x)", "!function(e,t){\"use strict\";var n=7,f=function(r){return r?n:e}}(this,24);",
        "module.exports = { a, b() { }, 'c': 1, get d() { return 2 }, async e() { }, [f]: 3, ...g }\n",
    ],
    "ts": [
        "let a: number = 1, b: string[] = [], c: Array<Map<string, number>> = x as any", "interface A<T> extends B { x: number; y?: string; readonly z: T; f(a: number): void; [k: string]: any; new (a: T): A<T> }", "type U = 'a' | 'b' | { x: number }; type F = (a: number, b?: string) => Promise<void>; type C = A extends B ? D : E; type M = { [K in keyof T]: T[K] }",
        "export function f<T extends object>(this: Window, a: T, b?: number, ...c: string[]): asserts a is T { return <any>a!; }", "enum E { A, B = 'x' }\ndeclare module 'm' { export const x: number }\nnamespace N.M { }\nabstract class A<T> implements I { private readonly x: number = 1; constructor(private a: string, public b = 2) { super() } abstract f(): void; static g<T>(x: T): T { return x } }",
        "import type { A } from './a';\nexport type { A };\nconst x = f<string>(1), y = a < b, z = (n: number): number => n * 2;", "@Component({ a: 1 }) export class D { @Input() x: string; m(@Inject(T) t: T) { } }", "function g(x: unknown): x is string { return typeof x === 'string' }",
    ],
    "lua": [
        "", "local a, b <const> = 1, 'x'\nfunction m.a.b:c(x, ...) return x, ... end\nlocal function f() end\nif a then b() elseif c then d() else e() end\nfor i = 1, 10, 2 do break end\nfor k, v in pairs(t) do goto done end\nwhile not a do repeat x() until y end\ndo local z = {1, 2; x = 3, ['y'] = 4, f(), } end\n::done::\nf 'x' { } (1)\nlocal s = [==[ ]] ]==] .. \"a\" -- c\n--[[ x\n]] a.b[1].c = #t ^ 2 // 3 ~= ~4\nreturn { f = f }",
    ],
    "php": [
        "", "just text", "<?php\ndeclare(strict_types=1);\nnamespace A\\B;\nuse C\\{D, E as F};\nuse function g;\nabstract class K extends L implements M, N { use T1, T2; const X = 1; public static ?int $p = 1, $q; final protected function f(?int &$a, string|int ...$b): static { return new static(...$c); } abstract function g(); }\ninterface I { function f(); }\ntrait T { }\nenum S: string { case A = 'a'; public function l(): string { return match ($this) { self::A, self::B => 'x', default => 'y' }; } }",
        "<?php if ($a): ?> x <?php elseif ($b): ?> y <?php else: ?> z <?php endif; foreach ($a as $k => [$b, $c]) { } for ($i = 0; $i < 3; $i++): endfor; while (1) { break 2; } do { } while (0); switch ($a) { case 1: default: }", "<?php $f = function ($x) use (&$y): int { return 1; }; $g = fn($x) => $x + 1; $a = [1, 'k' => 2, ...$b]; [$x, , $y] = $z; list('a' => $q) = $r; echo \"a {$b['c']} $d\", <<<EOT\n x\n EOT;",
        "<?php try { throw new \\E('x'); } catch (A | B $e) { } finally { } $o?->p->q()[1]::$r::S; (int) $x; isset($a, $b); @f(); $x ??= 1; `ls`; #[Attr(1)] function h() { static $n = 0; global $m; yield $k => $v; }\n$c = new class(1) extends D { };", "<?php return(function(){$a=1;})();", "<?php function f() { /*\n<<<<<<< HEAD\n*/ }",
    ],
}
INVALID = {
    "c": ["int f( {", "int f() { return 1; ", "int f() { if (a) else b; }", "a b c;", "int x = ;", "package a.b;", "# Title\n\ntext here\n", "<<<<<<< HEAD\nint a;\n=======\nint b;\n>>>>>>> x\n", "int f() { foo(a, }", "function f(a) { throw new Error(\"x\"); }", "int x = 1 /* open", "{ \"a\": 1 }", "int f() { x = { 1 }; }", "def f(x):\n    return 1\n"],
    "go": ["", "func f() { }", "package a\nfunc f( {\n}\n", "package a\nfunc f() {\n\tx := \n}\n", "package a\nfunc f() {\n", "package a\nx := 1\n", "package a\nimport x\n", "package a\nfunc f() {\n\tif x {\n\t}\n\telse {\n\t}\n}\n", "package a\nint x;\n", "package app.x;\n"],
    "java": ["class A {", "class A { int f( { } }", "class A { void f() { int x = ; } }", "class A { void f() { 1 + 2; } }", "class A { void f() { try { } } }", "class A { void f() { else { } } }", "int x;", "def f(x):\n  pass", "function f() { }", "class A { void f() { foo(1, } }", "<!DOCTYPE html><html></html>", "class A { void f() { log(\"x) } }"],
    "js": ["function f( {", "let = ;", "let a = 1 +", "if (a) else b", "a b", "{ \"a\": 1, \"b\": 2 }", "function f(a: number) { }", "foo(a, ", "const x = {", "try { }", "<<<<<<< ours\nlet a\n=======\n>>>>>>> b\n", "#include <x>", "from x import y", "'open", "/* open", "interface A { x: number }", "for (let i = 0; i < 3) { }", "return x y", "const a = `x"],
    "ts": ["let a: = 1", "function f(a: number { }", "interface A { x: }", "type X = ", "class A { x: number", "package main", "def f(): pass", "int f(int a) { return 1; }", "enum E { A B }"],
    "lua": ["function f(", "if a then", "local = 1", "x = ", "f(", "a b", "return 1 x = 2", "end", "for i = 1 do end", "--[[ open", "let x = 1;", "x + 1", "if a b end", "<<<<<<< a\n"],
    "php": ["<?php function f( {", "<?php $a = ;", "<?php if ($a) { ", "<?php $a b;", "<?php class { }", "<?php foo($a, ", "<?php } ", "<?php <<<<<<< HEAD\n$a = 1;\n", "<?php 'open", "<?php /* open", "<?php else { }", "<?php $x = 1 $y = 2;", "<?php def f(): pass"],
}


@pytest.mark.parametrize(("lang", "text"), [(la, t) for la, ts in VALID.items() for t in ts])
def test_valid(lang, text):
    assert parses(text, lang)


@pytest.mark.parametrize(("lang", "text"), [(la, t) for la, ts in INVALID.items() for t in ts])
def test_invalid(lang, text):
    assert not parses(text, lang)


@pytest.mark.parametrize(("lang", "text"), [(la, t) for la, ts in VALID.items() for t in ts if len(t) > 80])
def test_line_ends_do_not_matter_and_truncation_does(lang, text):
    if lang != "php" or "<?php" in text:
        cut = [text[:k] for k in range(len(text) // 2, len(text) - 5, max(1, len(text) // 9))]
        # a text cut inside brackets is never valid
        for c in cut:
            if sum(c.count(x) for x in "{([") > sum(c.count(x) for x in "})]") and not any(q in c for q in "'\"`/[") and lang != "php":
                assert not parses(c, lang)


def test_reduction_is_associative():
    from treeline.parsers.classes import token_classes
    from treeline.parsers.grammar import grammar

    g = grammar("c")
    s = token_classes(VALID["c"][2], "c")
    whole = g.reduce(s)
    for k in range(0, len(s), 7):
        assert g.reduce(g.reduce(s[:k]) + g.reduce(s[k:])) == whole
