"""Rules, suppression, baseline, report and formats over small DataFrames."""

import hashlib
import json
import random
import re
from types import SimpleNamespace
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from treeline.functions import text as T
from treeline.operators import duplicates, post, report, rules, tree
from treeline.sinks import fixer, formats, reports
from treeline.sources import baseline, config, files, globs
from treeline.sources.config import ConfigError


def sources(spark, *pairs):
    return files.from_table(spark.createDataFrame(list(pairs), "file string, source string"), F.col("file"), F.col("source"))


def messages(df):
    return [r.message for r in df.orderBy("file", "line").collect()]


def test_todo_tracker(spark):
    f = sources(
        spark, ("a.php", "<?php // TODO: tidy up\n# fixme   \n$todoList = 1; // TODOS\n$x = 'TODO';\n-- FIXME later"), ("b", "see http://TODO.example and https://FIXME"), ("c.c", "/* todo: a\rb\n// TODOя"), ("n", None), ("e", ""),
    )
    assert messages(rules.todo_tracker(f)) == ["TODO: tidy up", "FIXME", "FIXME: later", "TODO: a\rb", "TODO: я"]


def test_windows_script_encoding(spark):
    mark = "\ufeff"
    f = spark.createDataFrame([("a.ps1", "x\né"), ("b.ps1", f"{mark}é"), ("c.ps1", "plain"), ("d.bat", "é"), ("e.cmd", f"{mark}x"), ("f.sh", "é"), ("g.BAT", "a\n\nß")], "file string, source string")
    assert [(r.file, r.line) for r in rules.windows_script_encoding(f).orderBy("file").collect()] == [("a.ps1", 2), ("d.bat", 1), ("e.cmd", 1), ("g.BAT", 3)]


def test_hardcoded_secret(spark):
    token = "ghp_" + "a1" * 18
    f = sources(spark, ("a.php", f"<?php\n$t = \"{token}\";\n$password = 'correct-horse';\n$password = '';\n// token"))
    assert [r.line for r in rules.hardcoded_secret(f).orderBy("line").collect()] == [2, 3]


def php(spark, text):
    p = files.parse_files(sources(spark, ("a.php", text)))
    return files.php_rows(p)


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("<?php function f() { $a = 1; }", 1),
        ("<?php function f() { $a = 1; return $a; }", 0),
        ("<?php function f() { $_SESSION = 1; }", 0),
        ("<?php function f() { $a = 1; return compact('a'); }", 0),
        ("<?php function f() { $a = 1; return get_defined_vars(); }", 0),
        ("<?php function f() { $a = 1; return fn() => \"x $a\"; }", 0),
        ("<?php class A { function f($p) { $p = 1; } }", 1),
    ],
)
def test_unused_variable(spark, text, n):
    assert tree.unused_variable(php(spark, text)).count() == n


@pytest.mark.parametrize(
    ("text", "new"),
    [
        ("<?php\n/** @return array|null */\nfunction f($a = [1]) { }", ": array|null"),
        ("<?php\n/** @return array<int> */\nfunction f() { }", None),
        ("<?php\n/** @return int */\nfunction f(): int { }", None),
        ("<?php class A {\n/**\n * @return ?\\B\\C\n */\npublic static function f($x) { }\n}", ": ?\\B\\C"),
    ],
)
def test_promotable_return_type(spark, text, new):
    got = tree.promotable_return_type(php(spark, text)).collect()
    assert [r.fix.replacement for r in got] == ([new] if new else [])
    for r in got:
        out = fixer.splice(text.encode(), [(r.fix.start_offset, r.fix.end_offset, r.fix.replacement)]).decode()
        assert re.search(r"\)" + re.escape(new) + r" \{", out)


def test_fixer_overlap(spark):
    rows = [("a", (1, 3, "X"), 1), ("a", (2, 4, "Y"), 2), ("a", (5, 99, "Z"), 3)]
    df = spark.createDataFrame(rows, "file string, fix struct<start_offset:int,end_offset:int,replacement:string>, k int").withColumn("size", F.lit(6))
    got = post.select_fixes(df, F.col("size")).first().fixes
    assert fixer.splice(b"abcdef", [(x.start_offset, x.end_offset, x.replacement) for x in got]) == b"abYef"


# duplicates


def brute_duplicates(texts, k=8, cap=10):
    """Straight from the definition, one file after the other."""
    facts = {}
    for f in sorted(texts):
        kept = [(n + 1, re.sub(r"[ \t\n\r\f\v]+", "", x)) for n, x in enumerate(texts[f].split("\n")) if re.search(r"[^\W_]", x) and not re.match(r"\s*(?:import|use|#include)\b", x)]
        facts[f] = ([n for n, _ in kept], [hashlib.md5("\n".join(x for _, x in kept[i : i + k]).encode()).hexdigest()[:16] for i in range(len(kept) - k + 1)])
    index = {}
    for f, (_, hs) in facts.items():
        for i, h in enumerate(hs):
            index.setdefault(h, []).append((f, i))
    pairs = {}
    for h, occ in index.items():
        if 2 <= len(occ) <= cap:
            for i, a in enumerate(occ):
                for b in occ[i + 1 :]:
                    if a[0] != b[0] or b[1] - a[1] >= k:
                        pairs[a, b] = True
    out = {}
    for (a, b) in pairs:
        if ((a[0], a[1] - 1), (b[0], b[1] - 1)) in pairs:
            continue
        n = 1
        while ((a[0], a[1] + n), (b[0], b[1] + n)) in pairs:
            n += 1
        spans = [(f, facts[f][0][p], facts[f][0][p + n + k - 2]) for f, p in (a, b)]
        for me, other in (spans, spans[::-1]):
            seen = out.setdefault(me, [])
            if other not in seen:
                seen.append(other)
    return {(f, s, e): (o[0], len(o)) for (f, s, e), o in out.items()}


def test_duplicates_equal_definition(spark):
    rng = random.Random(2)
    pool = [[f"x{p}_{i} = {i};" for i in range(rng.randint(8, 14))] for p in range(6)]
    for _ in range(4):
        texts = {}
        for f in range(8):
            lines = []
            for _ in range(rng.randint(1, 4)):
                block = rng.choice(pool)
                lines += block[rng.randint(0, 2) :] if rng.random() < 0.5 else block
                lines += [f"own {f} {rng.random()}", "", "import z"][: rng.randint(0, 3)]
            texts[f"f{f}.js"] = "\n".join(lines)
        w = duplicates.windows(duplicates.facts(sources(spark, *texts.items())))
        loc = duplicates.locations(duplicates.runs(duplicates.pairs(w))).collect()
        got = {(r.file, r.start, r.end): ((r.other.file, r.other.start, r.other.end), r.others) for r in loc}
        assert got == brute_duplicates(texts)


def test_duplicate_golden(spark):
    shared = "\n".join(f"call_{i}(arg);" for i in range(8))
    f = sources(spark, ("a.php", f"<?php\n$a = 1;\n\n{shared}\n$z = 2;"), ("b.php", f"<?php\n$b = 9;\n{shared}"))
    got = sorted((r.file, r.line, r.end_line) for r in duplicates.duplicate_code(f).collect())
    assert got == [("a.php", 4, 11), ("b.php", 3, 10)]
    uses = "\n".join(f"use A\\B{i};" for i in range(10))
    assert duplicates.duplicate_code(sources(spark, ("a.php", f"<?php\n{uses}\n$a;"), ("b.php", f"<?php\n{uses}\n$b;"))).count() == 0
    assert duplicates.duplicate_code(sources(spark, ("a.txt", shared), ("b.php", None), ("c.php", ""), ("d.php", "\0" + shared), ("e.php", shared))).count() == 0


# suppression and baseline


def find(spark, *rows):
    return spark.createDataFrame(list(rows), "file string, line int, rule string")


def kept(spark, text, *rows):
    off = post.suppressions(sources(spark, ("a.php", text)), ("treeline", "otherlint"))
    return sorted((r.line, r.rule) for r in post.suppress(find(spark, *[("a.php", *x) for x in rows]), off).collect())


def test_suppressions(spark):
    both = ((2, "a-rule"), (2, "b-rule"))
    assert kept(spark, "x\ny // treeline-disable-line a-rule", *both) == [(2, "b-rule")]
    assert kept(spark, "# treeline-disable-next-line a-rule, b-rule -- because c-rule\nx", *both) == []
    assert kept(spark, "<!-- otherlint-disable-next-line -->\nx", *both) == []
    assert kept(spark, "x\ny\n/* treeline-disable-file b-rule */", *both) == [(2, "a-rule")]
    assert kept(spark, "x\ny treeline:ignore", *both) == []
    assert kept(spark, "x\n$s = 'treeline-disable-line a-rule';", *both) == list(both)
    assert kept(spark, "x\ny // treeline-disable-lines a-rule", *both) == list(both)
    assert kept(spark, "x\ny ** treeline-disable-line A_RULE", *both) == list(both)
    assert kept(spark, " * treeline-disable-next-line A_RULE\nx", *both) == []  # no valid name: all rules


def test_baseline_is_a_multiset_difference(spark):
    rows = [("a", 5, "r", "m"), ("a", 9, "r", "m"), ("a", 1, "r", "m"), ("b", 1, "r", "m"), ("a", 2, "q", "m")]
    f = spark.createDataFrame(rows, "file string, line int, rule string, message string")
    base = spark.createDataFrame([("a", "r", "m", 1), ("a", "r", "m", None), ("c", "r", "m", 3)], "file string, rule string, message string, count int")
    assert sorted((r.file, r.line, r.rule) for r in post.apply_baseline(f, base, ["line"]).collect()) == [("a", 2, "q"), ("a", 9, "r"), ("b", 1, "r")]
    assert post.apply_baseline(f, post.create_baseline(f), ["line"]).count() == 0
    assert post.apply_baseline(f, base.limit(0), ["line"]).count() == 5


def test_baseline_file(spark, tmp_path):
    f = spark.createDataFrame([("a", "r", "m/é"), ("a", "r", "m/é")], "file string, rule string, message string")
    path = str(tmp_path / "b.json")
    assert baseline.save(post.create_baseline(f), path) == 1
    assert json.load(open(path))["findings"] == [{"file": "a", "rule": "r", "message": "m/é", "count": 2}]
    assert baseline.load(spark, path).first()["count"] == 2
    assert baseline.entries({"findings": [{"file": "a", "rule": "r", "message": "m"}]}) == [("a", "r", "m", 1)]
    for bad in ({"findings": [{"file": 1}]}, [], {"findings": 1}, {"findings": [{"file": "a", "rule": "r", "message": "m", "count": "1"}]}):
        with pytest.raises(ConfigError):
            baseline.entries(bad)
    assert baseline.load(spark, str(tmp_path / "none"), must_exist=False).count() == 0
    with pytest.raises(ConfigError):
        baseline.load(spark, str(tmp_path / "none"))


def test_severities(spark):
    f = spark.createDataFrame([("a", "error"), ("b", "info"), ("c", "info")], "rule string, severity string")
    got = {r.rule: r.severity for r in post.override_severity(f, {"a": "info", "b": None}).collect()}
    assert got == {"a": "info", "c": "info"}


# paths and config


PATHS = ["a/generated/x.php", "src/gen.php", "src/a/b.gen.php", "legacy/old/y.php", "legacy/new/z.php", "src/keep.php"]


def test_globs(spark):
    patterns = ["generated", "src/**/*.gen.php", "./legacy/old/"]
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    kept = sorted(r.p for r in df.filter(~globs.excluded(F.col("p"), patterns)).collect())
    assert kept == ["legacy/new/z.php", "src/gen.php", "src/keep.php"] == sorted(p for p in PATHS if not globs.is_excluded(p, patterns))
    assert globs.is_excluded("a/b.c", ["?.c"]) and not globs.is_excluded("a/bb.c", ["?.c"]) and globs.is_excluded("x/y/z", ["x/*"]) and not globs.is_excluded("x", ["x/*"])


@pytest.mark.parametrize(
    "raw",
    [[], {"x": 1}, {"rules": []}, {"rules": {"todo-tracker": "loud"}}, {"exclude": "a"}, {"exclude": [""]}, {"exclude": [1]}, {"baseline": " "}, {"baseline": 1}, {"rules": {"a": 1}}],
)
def test_config_refuses(raw):
    with pytest.raises(ConfigError):
        config.read(raw, ".")


@pytest.mark.parametrize("rules_", [{"no-such-rule": "off"}, {"todo-tracker": {"max": 1}}, {"deep-nesting": {"depth": 1}}, {"deep-nesting": {"maxDepth": 0}}, {"duplicate-code": {"minLines": 1}}, {"long-function": {"maxStatements": "9"}}, {"long-function": {"maxStatements": True}}])
def test_options_refused(rules_):
    from treeline.engine import check_options

    with pytest.raises(ConfigError):
        check_options(config.read({"rules": rules_}, "."))


def test_config_discovery(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / ".treeline.json").write_text('{"rules": {"todo-tracker": "off"}, "baseline": "b.json"}')
    found = config.discover(str(tmp_path / "a" / "b"))
    c = config.load(found)
    assert c.disabled("todo-tracker") and c.baseline == str(tmp_path / "b.json")


# text functions


def test_text_functions(spark):
    df = spark.createDataFrame([("a\n\n   \n\tb\n", "my src*~.php"), ("a\0b", "é"), ("", "a"), (None, None)], "t string, u string")
    got = df.select(T.lines_of_code(F.col("t")).alias("n"), T.escape_uri(F.col("u")).alias("u"), T.first_non_ascii_line(F.col("u")).alias("l")).collect()
    assert [(r.n, r.u) for r in got] == [(2, "my%20src%2A~.php"), (0, "%C3%A9"), (0, "a"), (None, None)]
    assert [r.l for r in got] == [0, 1, 0, None]


# formats


def row(file, line, severity, rule="r", message="m", end_line=None, fix=None):
    return SimpleNamespace(file=file, line=line, severity=severity, rule=rule, message=message, end_line=end_line, fix=fix)


def test_sarif():
    found = [row("/p/my src/a.php", 0, "error", "b"), row("/p/x.php", 3, "warning", "a", end_line=5), row("/other/y.php", 2, "info", "a")]
    run = json.loads(formats.as_sarif(found, "/p"))["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["a", "b"]
    assert [(r["level"], r["ruleIndex"]) for r in run["results"]] == [("error", 1), ("warning", 0), ("note", 0)]
    where = [r["locations"][0]["physicalLocation"] for r in run["results"]]
    assert [w["artifactLocation"]["uri"] for w in where] == ["my%20src/a.php", "x.php", "file:///other/y.php"]
    assert where[0]["region"] == {"startLine": 1} and where[1]["region"] == {"startLine": 3, "endLine": 5}


def test_checkstyle_json_text():
    found = [row("a", 1, "error", message='<"&>'), row("a", 2, "info"), row("b", 3, "warning")]
    x = ET.fromstring(formats.as_checkstyle(found).split("\n", 1)[1])
    assert [(f.get("name"), len(f)) for f in x] == [("a", 2), ("b", 1)] and x[0][0].get("message") == '<"&>' and x[0][0].get("source") == "treeline.r"
    assert len(ET.fromstring(formats.as_checkstyle([]).split("\n", 1)[1])) == 0
    j = json.loads(formats.as_json(found))
    assert j["ok"] is False and len(j["findings"]) == 3 and json.loads(formats.as_json([])) == {"ok": True, "findings": []}
    assert formats.as_json([row("a/b", 1, "info")]).count("a\\/b") == 1
    assert formats.as_text(found).endswith("3 findings.\n") and formats.as_text([]) == "No findings.\n"


def test_annotations(spark):
    rows = [("/p/a,b:c.php", 0, None, "r", "error", "50% a\r\nb: c"), ("/q/x", 3, 4, "s", "warning", "m"), ("y", 1, None, "t", "info", "m")]
    df = spark.createDataFrame(rows, "file string, line int, end_line int, rule string, severity string, message string")
    got = [r.annotation for r in post.github_annotations(df, "/p").orderBy("rule").collect()]
    assert got == ["::error file=a%2Cb%3Ac.php,line=1,title=treeline r::50%25 a%0D%0Ab: c", "::warning file=/q/x,line=3,endLine=4,title=treeline s::m", "::notice file=y,line=1,title=treeline t::m"]


def test_report(spark):
    fn = "array<struct<name:string,line:int,cyclomatic:int,cognitive:int,statements:int>>"
    results = spark.createDataFrame([("/p/a.php", "PHP", 10, [("f", 1, 3, 2, 1), ("g", 5, 1, 0, 1)]), ("/p/b.php", "PHP", 6, None), ("/p/n.txt", None, 4, None), ("/p/e", None, 0, None), ("/p/x", None, None, None)], f"file string, language string, lines_of_code int, functions {fn}")
    rows = [("/p/a.php", 1, 4, "duplicate-code", "warning"), ("/p/a.php", 3, 6, "duplicate-code", "warning"), ("/p/b.php", 2, None, "x", "error"), ("/p/gone", 1, None, "x", "info")]
    f = spark.createDataFrame(rows, "file string, line int, end_line int, rule string, severity string").withColumn("message", F.lit("<m>")).withColumns({k: F.lit(0) for k in ("phase", "rule_ord", "k1", "k2")})
    m = reports.build(results, f, "/p")
    assert m["summary"] == {"files": 3, "linesOfCode": 20, "functions": 2, "findings": 4}
    assert [(x["language"], x["files"], x["linesOfCode"]) for x in m["languages"]] == [("PHP", 2, 16), ("other", 1, 4)]
    assert m["severities"] == {"error": 1, "warning": 2, "info": 1}
    assert [x["name"] for x in m["complexFunctions"]] == ["f"]
    assert [(x["file"], x["score"]) for x in m["hotspots"]] == [("b.php", 3), ("a.php", 2)]
    assert m["duplication"]["duplicatedLines"] == 6 and m["duplication"]["percent"] == 30.0 and m["duplication"]["fragments"] == 2
    assert "&lt;m&gt;" in reports.as_html(m) and "Languages" in reports.as_text(m) and json.loads(reports.as_json(m)) == m
    assert report.duplication(results.limit(0), f).first().percent == 0.0
    assert report.summary(results.limit(0), f.limit(0)).first().findings == 0
