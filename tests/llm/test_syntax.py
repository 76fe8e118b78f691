import random
import sys
from datetime import datetime

import pytest

from treeline.llm import syntax

SCHEMA = "file_id long, repo string, file string, source string, lang string, valid string"
C_TEXT = "int f(int a) {\n    /* one\n     * { two\n     */\n    if (a) {\n        return g(a, \"x{\");\n    }\n    return 0;\n}\n\n"
TEXTS = {
    "c": C_TEXT * 40, "go": "package a\n\n" + "func f(a int) int {\n\ts := `x {\n y`\n\treturn g(a,\n\t\ts)\n}\n\n" * 40, "js": "function f(a) {\n  const t = `x ${a\n  } {`\n  /* { */\n  return g(a,\n    t)\n}\n\n" * 40,
    "lua": "local function f(a)\n  --[[ x (\n  ]]\n  local s = [==[ { \n ]==]\n  if a then\n    return g(a,\n      s)\n  end\nend\n" * 40, "php": "<?php\n" + "function f($a)\n{\n    $s = 'x {\n y';\n    /* ( \n */\n    return g($a, $s);\n}\n" * 40,
    "java": "class A {\n" + "  void f(int a) {\n    String s = \"\"\"\n      { x\n      \"\"\";\n    g(a,\n      s);\n  }\n" * 40 + "}\n", "ts": "export function f(a: number): string {\n  return `x\n ${a}`;\n}\n" * 40,
    "python": "import a\n@a.b(\n  1)\n# x (\ndef f(a):\n    s = \"\"\"x ' (\n@ y\n\"\"\"\n    t = 'a\\\n(b'\n    return g(a,\nb)\nif f(1):\n    pass\nelse:\n    x = {1: [\n2], 3:\n4}\n@a\n@b\nclass A:\n    def f(self): return f'{1}'\n" * 12,
}


@pytest.mark.parametrize("lang", TEXTS)
@pytest.mark.parametrize("size", [10, 60, 333])
def test_chunks_fold_to_the_whole(lang, size):
    rng = random.Random(size)
    for text in (TEXTS[lang], TEXTS[lang][:-9], TEXTS[lang].replace("return", "return )", 1), TEXTS[lang][: rng.randint(50, 900)]):
        for many in (1, 4, 10_000):
            maps = [m for _, m in syntax.runs(text, lang, size, many)]
            assert syntax.decided(syntax.folded(maps, lang), lang) == syntax.parses(text, lang)


@pytest.mark.parametrize("lang", ["c", "python"])
def test_composition_is_associative(lang):
    text = C_TEXT * 3 if lang == "c" else TEXTS["python"][:900]
    maps = [m for _, m in syntax.runs(text, lang, 25, 1)]
    for a, b, c in zip(maps, maps[1:], maps[2:]):
        assert syntax.compose(syntax.compose(a, b, lang), c, lang) == syntax.compose(a, syntax.compose(b, c, lang), lang)


def verdicts(spark, rows, results=None, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    r = None if results is None else spark.createDataFrame(results, "file_id long, file string, language string, analyzed_at timestamp")
    return {x.file_id: x.valid for x in syntax.syntax_verdicts(df, r, **kw).collect()}


def test_edge_cases(spark):
    rows = [
        (1, "r", "a.php", "<?php f(", None, None), (2, "r", "a.py", "def f(:", None, None), (3, "r", "a.py", None, None, None), (4, "r", "a.js", "", None, None), (5, "r", "a.yml", "{{{", None, None), (6, "r", None, "x", None, None),
        (None, "r", "a.js", "(", None, None), (7, None, "a.lua", "x = 1\r\n", None, None), (7, None, "a.lua", "x = 1\r\n", None, None), (8, "r", "A.JS", "let a = 1", None, None), (9, "r", "a.py", "return 1", None, None), (10, "r", "a.py", "x = '\0'", None, None),
        (11, "r", "a.c", "int x; " * 200_000, None, None), (12, "r", "a.py", "(" * 5000, None, None), (13, "r", "a.py", "x = " + "(" * 5000 + "1" + ")" * 5000, None, None), (14, "r", "a.c", "int x;\n" * 30_000, None, None),
    ]
    got = verdicts(spark, rows)
    assert got == {1: False, 2: False, 3: True, 4: True, 7: True, 8: True, 9: False, 10: False, 11: True, 12: False, 13: False, 14: True}
    assert verdicts(spark, []) == {}


def test_long_files_give_the_same_through_chunks(spark):
    name = lambda la: "a.py" if la == "python" else f"a.{la}"
    rows = [(k, "r", name(la), t, None, None) for k, (la, t) in enumerate(TEXTS.items())] + [(100 + k, "r", name(la), t[:-4] if la == "python" else t[:-15], None, None) for k, (la, t) in enumerate(TEXTS.items())]
    assert verdicts(spark, rows, chunk_chars=20) == verdicts(spark, rows) == {**{k: True for k in range(len(TEXTS))}, **{100 + k: False for k in range(len(TEXTS))}}


def test_stated_language_wins(spark):
    rows = [(1, "r", "a.js", "local x = 1", None, None), (2, "r", "a.lua", "local x = 1", None, None)]
    t = datetime(2026, 1, 1)
    results = [(1, "a.js", " LUA", t), (1, "a.js", "JavaScript", datetime(2025, 1, 1)), (2, "a.lua", None, t), (2, "a.lua", "??", t)]
    assert verdicts(spark, rows) == {1: False, 2: True}
    assert verdicts(spark, rows, results) == {1: True, 2: True}
    assert verdicts(spark, rows, results[:0]) == {1: False, 2: True}
    assert verdicts(spark, [*rows, (3, "r", "a.txt", "local x =", None, None)], [*results, (3, "a.txt", "lua", t)]) == {1: True, 2: True, 3: False}


def test_the_copy_loaded_last_counts(spark):
    rows = [(1, "r", "a.c", "int x;", 2), (1, "r", "a.c", "int x", 1), (1, "r", "a.c", "int x", 1), (2, "r", "b.c", "int x;", 1), (2, "r", "b.c", "int", 3)]
    df = spark.createDataFrame([(*r[:4], datetime(2026, 1, r[4])) for r in rows], "file_id long, repo string, file string, source string, loaded_at timestamp")
    assert {r.file_id: r.valid for r in syntax.syntax_verdicts(df).collect()} == {1: True, 2: False}


def test_rates(spark):
    rows = [(1, "r", "a.c", "int x;", None, None), (2, "r", "b.c", "int", None, None), (3, "s", "a.py", "x", None, None)]
    got = {(r.repo, r.lang): (r.files, r.broken, r.rate) for r in syntax.broken_rates(syntax.syntax_verdicts(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {("r", "c"): (2, 1, 0.5), ("s", "python"): (1, 0, 0.0)}


def test_python_needs_no_warnings():
    assert syntax.python_parses("x = '\\d'\nassert (1, 'x')\n")
    assert sys.version_info >= (3, 10)


SPANNING = {
    "php": "<?php\nf($a);\n$s = <<<EOT\n ( {\n it's\nEOT;\n$t = <<<'X'\n \" [\nX;\n$u = `ls\n {`;\n?>\n<p>it's (\n</p>\n<?php\n/* ' */\ng('x\ny');\n",
    "c": "#define F(a) \\\n  do { g(a); \\\n  (\nint f(void) {\n  return g(\"x \\\n ( y\");\n}\n", "lua": "local s = [====[ {\n ]] ( ]===]\n]====]\n--[===[ x (\n]]\n]===]\nf(s)\n",
    "js": "const t = `x ${f(`y {\n ${1}`)\n} (\n`;\n// it`s\nf(t);\n", "ts": "const t: string = `x ${f(`y {\n ${1}`)\n} (\n`;\n// it`s\nf(t);\n",
    "go": "package a\n\n// it`s\nfunc f() {\n\ts := `x {\n\"`\n\t/* ' (\n */\n\tg(s)\n}\n", "java": "class A {\n  String s = \"\"\"\n    { \" (\n    \"\"\";\n  /* \"\"\"\n */\n}\n",
}


@pytest.mark.parametrize("lang", SPANNING)
def test_cuts_may_lie_inside_constructs(spark, lang):
    head, text = ("package a\n", SPANNING[lang].removeprefix("package a\n") * 20) if lang == "go" else ("", SPANNING[lang] * 20)
    text = head + (text if lang != "php" else SPANNING[lang] + SPANNING[lang].removeprefix("<?php\n") * 19)
    texts = [text, text[:-4], text + "`\n", text + "f(\n", *(text[:k] for k in range(40, 400, 23)), *(text[:k] + "#!x\n" + text[k:] for k in (text.index("\n", 150) + 1,))]
    name = f"a.{lang}"
    rows = [(k, "r", name, t, None, None) for k, t in enumerate(texts)]
    whole = {k: syntax.parses(t, lang) for k, t in enumerate(texts)}
    assert whole[0] and not all(whole.values())
    for size in (10, 45, 130):
        assert {k: syntax.decided(syntax.folded([m for _, m in syntax.runs(t, lang, size, 2)], lang), lang) for k, t in enumerate(texts)} == whole
        assert len(syntax.cut_at_lines(text, size)) > 5
        assert verdicts(spark, rows, chunk_chars=size) == whole


def test_elements_are_read_in_their_files_only(spark):
    text = "const a = <ul>\n" + "  {b.map((x) => <li key={x}>it's {x}</li>)}\n" * 40 + "</ul>;\n"
    rows = [(1, "r", "a.jsx", text, None, None), (2, "r", "b.tsx", text, None, None), (3, "r", "c.js", text, None, None), (4, "r", "d.jsx", text.replace("</ul>", ""), None, None)]
    assert verdicts(spark, rows, chunk_chars=50) == verdicts(spark, rows) == {1: True, 2: True, 3: False, 4: False}
