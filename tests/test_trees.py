"""Structural rules on small texts of every language."""

import pytest

from treeline.operators import tree
from treeline.parsers import trees
from treeline.sources import files as S

RULES = {
    "dead": tree.dead_code_after_return,
    "catch": tree.empty_catch,
    "function": tree.empty_function,
    "long": tree.long_function,
    "block": tree.empty_block,
    "deep": tree.deep_nesting,
}
CALLS = {";": "g();\n" * 31, "": "g()\n" * 31}
CHAIN_C = "if (x == 1) { a(); } else if (x == 2) { b(); } else if (x == 3) { c(); } else { d(); }"

# language -> (extension, dead code, empty catch or None, empty function or None, long function or None, clean)
CASES = {
    "C": ("c", "int f() { if (1) { return 1; dead(); } return 0; }", None, "void f() { }", "void f() { %s }" % CALLS[";"], "int f() { if (1) { return 1; } return 0; }"),
    "C++": ("cpp", "int A::f() { while (1) { return 1; dead(); } }", "int f() { try { g(); } catch (int e) { } return 0; }", "void f() { }", "void f() { %s }" % CALLS[";"], "int f() { for (auto x : xs) { return 1; } return 2; }"),
    "C#": ("cs", "class A { int F() { if (x) { return 1; Dead(); } return 0; } }", "class A { int F() { try { G(); } catch (Exception e) { } return 0; } }", "class A { void F() { } }", "class A { void F() { %s } }" % CALLS[";"], "interface I { void F(); }"),
    "Java": ("java", "class A { int f() { for (int i = 0; i < 1; i++) { return 1; dead(); } return 0; } }", "class A { int f() { try { g(); } catch (Exception e) { } return 0; } }", "class A { void f() { } }", "class A { void f() { %s } }" % CALLS[";"], "interface I { void f(); }"),
    "Python": ("py", "def f(x):\n    if x:\n        return 1\n        dead()\n    return 0\n", "try:\n    g()\nexcept Exception:\n    pass\n", None, "def f():\n" + "    g()\n" * 31, "def f(x):\n    if x:\n        return 1\n    return 0\n"),
    "Rust": ("rs", "fn f(x: i32) -> i32 { if x > 0 { return 1; dead(); } 0 }", None, "fn f() { }", "fn f() { %s }" % CALLS[";"], "fn f(x: i32) -> i32 { if x > 0 { return 1; } 0 }"),
    "Swift": ("swift", "func f(x: Int) -> Int {\n if x > 0 {\n return 1\n dead()\n }\n return 0\n}\n", "func f() {\n do {\n try g()\n } catch {\n }\n}\n", "func f() {\n}\n", "func f() {\n%s}\n" % CALLS[""], "func f(x: Int) -> Int {\n for i in 0..<3 {\n if i == 1 { break }\n }\n return 0\n}\n"),
    "Go": ("go", "package a\nfunc f(x int) int {\n if x > 0 {\n return 1\n dead()\n }\n return 0\n}\n", None, "package a\nfunc f() {\n}\n", "package a\nfunc f() {\n%s}\n" % CALLS[""], "package a\nfunc (r R) f(x int) int {\n if x > 0 {\n return 1\n }\n return 0\n}\n"),
    "Kotlin": ("kt", "fun f(x: Int): Int {\n if (x > 0) {\n return 1\n dead()\n }\n return 0\n}\n", "fun f() {\n try {\n g()\n } catch (e: Exception) {\n }\n}\n", "fun f() {\n}\n", "fun f() {\n%s}\n" % CALLS[""], "fun f(x: Int): Int {\n if (x > 0) {\n return 1\n }\n return 0\n}\n"),
    "Ruby": ("rb", "def f(x)\n  if x\n    return 1\n    dead\n  end\nend\n", "begin\n  g\nrescue E\nend\n", "def f\nend\n", "def f\n%send\n" % ("  g()\n" * 31), "def f(x)\n  return 1 if x\n  0\nend\n"),
    "Dart": ("dart", "int f() { if (x) { return 1; dead(); } return 0; }", "void f() { try { g(); } catch (e) { } }", "void f() { }", "void f() { %s }" % CALLS[";"], "int f() { if (x) { return 1; } return 0; }"),
    "Zig": ("zig", "fn f(x: i32) i32 { if (x > 0) { return 1; dead(); } return 0; }", None, "fn f() void { }", "fn f() void { %s }" % CALLS[";"], "fn f(x: i32) i32 { if (x > 0) { return 1; } return 0; }"),
    "Solidity": ("sol", "contract A { function f() public { return 1; dead(); } }", "contract A { function f() public { try b.g() returns (uint v) { h(v); } catch { } } }", "contract A { function f() public { } }", "contract A { function f() public { %s } }" % CALLS[";"], "contract A { function f() public { if (x) { return 1; } } }"),
    "Lua": ("lua", "function f(x)\n if x then\n return 1\n end\nend\n", None, "function f()\nend\n", "function f()\n%send\n" % CALLS[""], "local function f(x)\n if x then return 1 end\n return 0\nend\n"),
    "PHP": ("php", "<?php function f() { return 1; echo 2; }", "<?php try { g(); } catch (E $e) { }", "<?php function f() { }", "<?php function f() { %s }" % CALLS[";"], "<?php function f() { return 1; }"),
    "JavaScript": ("js", "function f() { return 1; g() }", "try { g() } catch (e) { }", "function f() { }", "function f() { %s }" % CALLS[";"], "const f = () => { }; class A { constructor() { } }"),
    "TypeScript": ("ts", "function f(): number { return 1; g() }", "try { g() } catch { }", "function f(): void { }", "function f() { %s }" % CALLS[";"], "interface I { f(): void }"),
    "Objective-C": ("m", "int f() { if (1) { return 1; dead(); } }", "void f() { @try { g(); } @catch (E *e) { } }", None, None, "int f() { if (1) { return 1; } }"),
    "NyxilumLang": ("nx", "func f(x) {\n if x {\n return 1\n dead()\n }\n}\n", None, "func f() {\n}\n", "func f() {\n%s}\n" % CALLS[""], "func f(x) {\n return x\n}\n"),
}


def parsed(name, text, language=None):
    error, nodes, _ = S.parse_one(name, text, language)
    return error, [dict(zip(tree.NODE_COLUMNS, n)) for n in nodes]


def found(text, name, rule, language=None):
    """How many findings a structural rule has, without Spark: the rule's own condition on node rows."""
    error, nodes = parsed(name, text, language)
    assert error is None, error
    count = 0
    for n in nodes:
        if rule == "dead":
            count += n["type"] == "Return" and n["parent_type"] == "Block" and n["next_line"] is not None and not any(m["type"] == "Return" and m["parent_id"] == n["parent_id"] and m["ord"] < n["ord"] for m in nodes)
        elif rule == "catch":
            count += n["parent_type"] == "CatchClause" and n["ord"] == 0 and n["n_children"] == 0 and bool(n["parent_empty"])
        elif rule == "function":
            count += n["parent_type"] == "FunctionDecl" and n["first_block"] and n["n_children"] == 0 and bool(n["parent_empty"]) and n["parent_name"] not in tree.MAY_BE_EMPTY
        elif rule == "long":
            count += n["parent_type"] == "FunctionDecl" and n["first_block"] and n["n_children"] > 30
        elif rule == "block":
            count += n["parent_type"] in tree.LOOPS_AND_IF and n["type"] == "Block" and n["n_children"] == 0 and bool(n["parent_empty"])
        elif rule == "deep":
            count += n["type"] in tree.CONTROL and n["depth"] > 4
    return count


@pytest.mark.parametrize("language", CASES)
def test_language(language):
    ext, dead, catch, empty, long, clean = CASES[language]
    name = f"x.{ext}"
    if language != "Lua":
        assert found(dead, name, "dead") == 1
    if catch:
        assert found(catch, name, "catch") == 1
    if empty:
        assert found(empty, name, "function") == 1
    if long:
        assert found(long, name, "long") == 1
    for rule in ("dead", "catch", "function", "long", "block", "deep"):
        assert found(clean, name, rule) == 0, rule


def chain_metrics(name, text):
    error, nodes = parsed(name, text)
    assert error is None
    assert sum(n["type"] == "FunctionDecl" for n in nodes) == 1
    branches = [n for n in nodes if n["type"] in tree.BRANCH and n["owner"] >= 0]
    return 1 + len(branches), sum(1 if n["else_if"] else 1 + n["nest"] for n in branches)


CHAINS = {
    "c.c": "int f(int x) { %s }", "c.cpp": "int f(int x) { %s }", "c.cs": "class A { void F(int x) { %s } }", "c.dart": "void f(int x) { %s }", "c.java": "class A { void f(int x) { %s } }", "c.js": "function f(x) { %s }", "c.kt": "fun f(x: Int) { %s }",
    "c.php": "<?php function f($x) { %s }", "c.sol": "contract A { function f(uint x) public { %s } }", "c.ts": "function f(x: number) { %s }", "c.zig": "fn f(x: i32) void { %s }", "c.rs": "fn f(x: i32) { %s }", "c.swift": "func f(x: Int) { %s }", "c.go": "package a\nfunc f(x int) { %s }",
}


@pytest.mark.parametrize("name", CHAINS)
def test_else_if_chain(name):
    body = CHAIN_C.replace("; }", " }") if name.endswith(("go", "swift")) else CHAIN_C
    if name.endswith(("rs", "swift", "go")):
        body = body.replace("(x == 1)", "x == 1").replace("(x == 2)", "x == 2").replace("(x == 3)", "x == 3")
    assert chain_metrics(name, CHAINS[name] % body) == (4, 3)


@pytest.mark.parametrize(
    ("name", "text"),
    [
        ("c.py", "def f(x):\n    if x == 1:\n        a()\n    elif x == 2:\n        b()\n    elif x == 3:\n        c()\n    else:\n        d()\n"),
        ("c.rb", "def f(x)\n  if x == 1\n    a\n  elsif x == 2\n    b\n  elsif x == 3\n    c\n  else\n    d\n  end\nend\n"),
        ("c.lua", "function f(x)\n  if x == 1 then\n    a()\n  elseif x == 2 then\n    b()\n  elseif x == 3 then\n    c()\n  else\n    d()\n  end\nend\n"),
        ("c.php", "<?php function f($x) { if ($x): a(); elseif ($y): b(); elseif ($z): c(); else: d(); endif; }"),
    ],
)
def test_else_if_chain_of_words(name, text):
    assert chain_metrics(name, text) == (4, 3)


PHP = [
    ("<?php function f() { return 1; echo 'x'; }", "dead", 1),
    ("<?php function f() { echo 'x'; return 1; }", "dead", 0),
    ("<?php class A { public function f() { return 1; echo 'x'; } }", "dead", 1),
    ("<?php g(function () { return 1; echo 'x'; });", "dead", 1),
    ("<?php try { g(); } catch (E $e) { h(); }", "catch", 0),
    ("<?php try { g(); } catch (E $e) { /* fine */ }", "catch", 0),
    ("<?php if ($a) { for (;;) { while ($b) { foreach ($c as $d) { do { x(); } while (1); } } } }", "deep", 1),
    ("<?php if ($a) { for (;;) { while ($b) { foreach ($c as $d) { x(); } } } }", "deep", 0),
    ("<?php function f() { /* nothing */ }", "function", 0),
    ("<?php interface I { public function f(); }", "function", 0),
    ("<?php $f = function () { };", "function", 0),
    ("<?php class A { function __construct() { } }", "function", 0),
    ("<?php function f() { %s }" % ("g();" * 30), "long", 0),
    ("<?php if ($a) { }", "block", 1),
    ("<?php for (;;) { }", "block", 1),
    ("<?php while ($a) { }", "block", 1),
    ("<?php do { } while ($a);", "block", 1),
    ("<?php if ($a) { // later\n }", "block", 0),
    ("<?php if ($a) { x(); } else { }", "block", 1),  # the search goes on past braces that hold something
]


@pytest.mark.parametrize(("text", "rule", "n"), PHP)
def test_php_rule(text, rule, n):
    assert found(text, "a.php", rule) == n


@pytest.mark.parametrize("ext", ["js", "ts"])
def test_js_chain_is_not_deep(ext):
    text = "if (a) { x() } " + " ".join(f"else if (b{k}) {{ x() }}" for k in range(8))
    assert found(text, f"a.{ext}", "deep") == 0


# What a handler does, and whether the error is ignored.
HANDLERS = {
    "pass": True, "pass  # the cache may be cold": True, "# the cache may be cold\n            pass": False, "hits = None": False, "raise Miss(key) from error": False, "return fallback": False, "journal.note(error)": False, "continue": False,
}


@pytest.mark.parametrize("body", HANDLERS)
def test_python_handlers(body):
    text = f"def lookup(keys, fallback):\n    for key in keys:\n        try:\n            hits = cache[key]\n        except KeyError as error:\n            {body}\n    return hits\n"
    assert found(text, "cache.py", "catch") == HANDLERS[body]


# Lua bodies have no braces: an empty one is known by its words.
BODIES = {
    "if ready(queue) then\nend": 1, "while queue:next() do\nend": 1, "for slot = first, last, 2 do\nend": 1, "for name, slot in queue:each() do\nend": 1, "repeat\nuntil queue:closed()": 1, "do\nend": 0,
    "while queue:next() do\n  handle(queue)\nend": 0, "if ready(queue) then\n  handle(queue)\nelse\nend": 1,
}


@pytest.mark.parametrize("body", BODIES)
def test_lua_bodies(body):
    assert found(f"local queue = open(1)\n{body}\nqueue:close()\n", "queue.lua", "block") == BODIES[body]


def test_emptiness_by_text():
    e = trees.genuinely_empty
    assert not e(b"f() { }", 0)
    assert not e(b"f() { }", 9)
    assert e(b"f() {  }", 1)
    assert not e(b"f() { /* a */ }", 1)
    assert not e(b"\nf() { // a\n }", 2)
    assert e(b"no braces", 1)
    assert e(b"a { x } b { }", 1)
    assert e(b"f() {" + b"x" * 500, 1)


def test_language_by_extension():
    assert trees.language_for("a/b.PHP") is None
    assert trees.language_for("a/b.mjs").name == "JavaScript"
    assert trees.language_for("x.hxx").name == "C++"
    assert trees.language_for("x") is None


def test_foreach_is_told_from_for():
    def kinds(name, text):
        return [n["type"] for n in parsed(name, text)[1] if n["type"] in ("For", "Foreach")]

    assert kinds("a.js", "for (const a of b) { c() } for (let i = 0; i < 1; i++) { d() }") == ["Foreach", "For"]
    assert kinds("a.java", "class A { void f() { for (A a : b) { } for (int i = 0; i < (c ? 1 : 2); i++) { } } }") == ["Foreach", "For"]
    assert kinds("a.py", "for a in b:\n    c()\n") == ["Foreach"]
    assert kinds("a.rs", "fn f() { for a in b { c(); } }") == ["Foreach"]
    assert kinds("a.go", "package a\nfunc f() { for range b { c() } }") == ["For"]
    assert kinds("a.lua", "for i = 1, 2 do f() end for k, v in p(t) do g() end") == ["For", "Foreach"]
