"""Elements in JavaScript, and validity of languages without a grammar."""

import pytest

from treeline.parsers import grammar, jsx, trees
from treeline.sources import files as S

APP = """import React from "react";
export function App({ items, onPick }) {
  const title = <h1 className="a" {...rest}>Hi, it's {name}!</h1>;
  if (a < b && c > d) { return null; }
  return (
    <>
      <List.Item key={1} data-x='y' render={() => { return <b>ok</b>; }} disabled>
        {/* nothing */}
        {items.map((x) => <li key={x.id} onClick={() => onPick(x)}>{x.a ? <i/> : null} &amp; text</li>)}
        <br/><img src="a"/>
      </List.Item>
    </>
  );
}
"""
TYPED = """const id = <T,>(x: T): T => x;
function f<P extends object>(p: P): JSX.Element {
  const xs: Array<number> = [1];
  return <div title="x">{xs.map((n: number) => <span key={n}>{n as number}</span>)}</div>;
}
"""


@pytest.mark.parametrize(("text", "lang", "file"), [(APP, "js", "a.jsx"), (TYPED, "ts", "a.tsx"), ("const a = <b/>;\n", "js", "a.jsx")])
def test_elements_become_arrays(text, lang, file):
    plain = jsx.without_elements(text)
    assert len(plain) == len(text) and [len(x) for x in plain.split("\n")] == [len(x) for x in text.split("\n")]
    assert grammar.parses(plain, lang) and (lang == "ts" or not grammar.parses(text, lang))
    assert S.parse_one(file, text, trees.language_for(file).name)[0] is None


def test_functions_inside_elements_are_nodes():
    nodes = S.parse_one("a.jsx", APP, "JavaScript")[1]
    assert [n[5] for n in nodes if n[4] == "FunctionDecl"] == [2, 7, 9, 9]


@pytest.mark.parametrize("bad", ["const a = <div>;", "const a = <div></span>;", "const a = <div>{</div>;", "const a = <div>{1 +}</div>;", "const a = <div b=></div", "return <"])
def test_broken_elements(bad):
    assert S.parse_one("a.jsx", bad, "JavaScript")[0]


def test_plain_files_hold_no_elements():
    assert S.parse_one("a.js", "const a = <b/>;\n", "JavaScript")[0] and jsx.without_elements("if (a < b) { c(d > e); }") == "if (a < b) { c(d > e); }"


INCOMPLETE = [
    ("a.rs", "fn f() { let = = ; }"), ("a.cs", "class A { int x = ; }"), ("a.cpp", "int f() { return 1 + ; }"), ("a.kt", "fun f() { val x = (1 + ) }"), ("a.swift", "func f() { let x = 1 + }"), ("a.dart", "void f() { g(1 == ); }"), ("a.zig", "fn f() void { x += ; }"),
    ("a.m", "void f() { x = a - ; }"), ("a.sol", "contract A { uint x = ; }"), ("a.rb", "def f(x\n  1\nend\n"), ("a.rb", "class A\n  def f\n    1\n  end\n"), ("a.rb", "def f\n  1\nend\nend\n"),
]
COMPLETE = [
    ("a.rs", "fn f(a: &str) -> i32 { let x = a.len() as i32 * 2; g(|y| y + 1); match x { 1..=2 => {} _ => {} } 3 }"), ("a.rs", "macro_rules! m { ($($x:expr),+) => { f($($x),+) } }"), ("a.cpp", "struct A { A& operator=(const A& o) = default; bool operator==(A&&) const; };\nauto f = [=](int* p, int&&) { return *p; };"),
    ("a.cs", "class A { int F(int x) => x + 1; static A operator +(A a, A b) => a; }"), ("a.kt", "fun f(x: Int = 1) = x!! + 2\n"), ("a.swift", "let s = [1, 2].reduce(0, +)\nlet t = a.sorted(by: >)\n"), ("a.dart", "class A { A operator +(A o) => this; int? x; }"), ("a.zig", "const a = b +% c; fn f() !void {}"),
    ("a.m", "@interface A\n- (void)f;\n+ (void)g;\n@end\n"), ("a.sol", "contract A { function f(uint a) public returns (uint) { return a ** 2; } }"),
    ("a.rb", "class A\n  attr_reader :class, :end\n  def f(x) = x + 1\n  def g(x)\n    return 1 if x.class == A\n    y = if x then 2 else 3 end\n    [1].each do |z|\n      puts z unless z\n    end\n    { end: 1, if: 2 }\n  end\n  def self.end; 1; end\nend\n"),
    ("a.rb", "x = y / 2\ns = <<~SQL\n  begin class (\nSQL\n"), ("a.rb", "f(%w[a b], /\\(/)\n__END__\ndef ("),
]


@pytest.mark.parametrize(("file", "text"), INCOMPLETE)
def test_incomplete_texts(file, text):
    assert S.parse_one(file, text, trees.language_for(file).name)[0]


@pytest.mark.parametrize(("file", "text"), COMPLETE)
def test_complete_texts(file, text):
    assert S.parse_one(file, text, trees.language_for(file).name)[0] is None


def test_emptiness_takes_one_pass():
    assert trees.genuinely_empty(b"if (a) { }", 1) and not trees.genuinely_empty(b"if (a) { /* x */ }", 1) and trees.genuinely_empty(b"f({a: 1}, () => {})", 1)
    assert not trees.genuinely_empty(b"x\nif (a) {\n// y\n}", 2) and trees.genuinely_empty(b"if (a) { b", 1) and not trees.genuinely_empty(b"x", 3)
    assert trees.genuinely_empty(b"{" * 200_000, 1)


def test_arrows_with_an_expression_are_functions():
    functions = lambda file, text: [(n[5], n[6]) for n in S.parse_one(file, text, trees.language_for(file).name)[1] if n[4] == "FunctionDecl"]
    text = "const f = (x) => x + 1\nconst g = xs.map(x => [x, (y) => y *\n  2], z)\nif (a) { b() }\n"
    assert functions("a.js", text) == [(1, "{closure}"), (2, "{closure}"), (2, "{closure}")]
    assert functions("a.ts", "let f: (x: number) => void = (x: number): void => g(x);\n") == [(1, "{closure}")]
    kinds = [n[4] for n in S.parse_one("a.js", text, "JavaScript")[1]]
    assert kinds.count("If") == 1
