import json
import os
import time

import pytest
from pyspark.sql import functions as F

from treeline import cli
from treeline.engine import Engine
from treeline.operators import post
from treeline.parsers import trees
from treeline.sinks import formats
from treeline.sources import files
from treeline.sources.config import Config
from treeline.streaming import files as stream

PHP = "<?php\n/**\n * @return array|null\n */\nfunction f($x)\n{\n    // TODO: tidy up\n    $unused = 1;\n    try { g(); } catch (\\Exception $e) { }\n    if ($x) { return 1; echo 2; }\n    return null;\n}\n"


@pytest.fixture
def project(tmp_path):
    for name, text in {"src/a.php": PHP, "src/b.js": "function b() {}\n", "src/c.php": "<?php function z( {\n", "vendor/v.php": "<?php // TODO x\n", "notes.txt": "// FIXME: n\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    return tmp_path


def run(capsys, *argv):
    code = cli.main([str(a) for a in argv])
    return code, capsys.readouterr().out


def test_text_and_exit_codes(spark, project, capsys):
    code, out = run(capsys, project)
    assert code == 1
    rules = [line.split("[")[1].split("]")[0] for line in out.splitlines()[:-1]]
    assert rules == ["todo-tracker", "dead-code-after-return", "empty-catch", "unused-variable", "promotable-return-type", "todo-tracker", "empty-function", "parse-error"]
    code, out = run(capsys, project, "--no-todo")
    assert "todo-tracker" not in out
    (project / "ok").mkdir()
    (project / "ok" / "a.js").write_text("let a = 1\n")
    assert run(capsys, project / "ok") == (0, "No findings.\n")
    assert run(capsys, project / "none")[0] == 2
    assert run(capsys)[0] == 2
    assert run(capsys, project, "--format", "json")[0] == 2
    assert run(capsys, "report", project, "--fix")[0] == 2
    assert run(capsys, project, "--jobs", "0")[0] == 2


def test_json_and_single_file(spark, project, capsys):
    code, out = run(capsys, project / "src" / "a.php", "--json")
    j = json.loads(out)
    assert code == 1 and not j["ok"] and {f["rule"] for f in j["findings"]} >= {"empty-catch", "unused-variable"}
    assert [f["fix"]["replacement"] for f in j["findings"] if f["fix"]] == [": array|null"]


def test_config_severity_exclude_baseline(spark, project, capsys):
    (project / "treeline.json").write_text(json.dumps({"rules": {"todo-tracker": "off", "empty-catch": "error"}, "exclude": ["c.php", "src/b.*"], "baseline": "known.json"}))
    _, out = run(capsys, project)
    assert "parse-error" not in out and "todo" not in out and "empty-function" not in out and "x " + str(project / "src/a.php") + ":9 [empty-catch]" in out
    run(capsys, project, "--create-baseline", project / "known.json")
    assert run(capsys, project) == (0, "No findings.\n")
    (project / "src" / "a.php").write_text(PHP.replace("// TODO: tidy up", "\n\n") + "<?php\n"[:0])
    assert run(capsys, project)[0] == 0  # lines moved, nothing new
    (project / "src" / "d.php").write_text("<?php try { g(); } catch (E $e) { }\n")
    code, out = run(capsys, project)
    assert code == 1 and out.count("empty-catch") == 1
    (project / "treeline.json").write_text("{")
    assert run(capsys, project)[0] == 2


def test_fix(spark, project, capsys):
    run(capsys, project / "src" / "a.php", "--fix")
    assert "function f($x): array|null\n" in (project / "src" / "a.php").read_text()


def test_report_formats(spark, project, capsys):
    code, out = run(capsys, "report", project, "--format", "json")
    m = json.loads(out)
    assert code == 0 and m["summary"]["files"] == 4 and {x["language"] for x in m["languages"]} == {"PHP", "JavaScript", "other"}
    target = project / "r.html"
    assert run(capsys, "report", project, "--format", "html", "--output", target)[0] == 0
    assert target.read_text().startswith("<!doctype html>")


def test_cache_gives_the_same(spark, project, capsys):
    cache = project / "cache.d"
    cold = run(capsys, project / "src", "--cache", cache)
    files_kept = spark.read.parquet(f"{cache}/{json.loads((cache / '_current').read_text())['table']}").filter("row = 'file'").count()
    assert files_kept == 2  # what doesn't parse isn't kept
    assert run(capsys, project / "src", "--cache", cache) == cold
    (project / "src" / "b.js").write_text("function b() { c() }\n")
    _, out = run(capsys, project / "src", "--cache", cache)
    assert "empty-function" not in out and "empty-catch" in out
    assert len(list(cache.glob("rows-*"))) == 2  # the one in use, and the one before
    (cache / "_current").write_text("other")
    assert run(capsys, project / "src", "--cache", cache)[1] == out


def test_scan(spark, project):
    assert [os.path.relpath(p, project) for p in files.list_files(str(project))] == ["notes.txt", "src/a.php", "src/b.js", "src/c.php"]
    assert files.list_files(str(project / "vendor" / "v.php")) == [str(project / "vendor" / "v.php")]
    with pytest.raises(FileNotFoundError):
        files.list_files(str(project / "none"))
    got = {os.path.basename(r.file): r.language for r in files.scan_binary(spark, str(project)).collect()}
    assert got["a.php"] == "PHP" and got["notes.txt"] is None
    listed = spark.createDataFrame([(str(project / "gone.php"),)], "file string").mapInPandas(files._read, files.FILES)
    assert files.unreadable(listed).first().rule == "unreadable-file"


def test_invalid_utf8_is_read(spark, tmp_path):
    (tmp_path / "a.php").write_bytes(b"<?php // TODO: \xff\n")
    a = Engine(spark).analyze_path(str(tmp_path))
    assert [r.message for r in a.findings.collect()] == ["TODO: \ufffd"]


def test_duplicates_suppression_and_options(spark):
    shared = "\n".join(f"call_{i}(arg);" for i in range(5))
    rows = [("a.php", f"<?php\n// treeline-disable-next-line duplicate-code\n{shared}\n"), ("b.php", f"<?php\n$b = 9;\n{shared}\n")]
    f = spark.createDataFrame(rows, "file string, source string").withColumn("language", F.lit("PHP")).withColumn("content", F.encode("source", "UTF-8")).withColumn("error", F.lit(None).cast("string"))
    one = Engine(spark).with_config(Config(options={"duplicate-code": {"minLines": 4}})).analyze(f).findings.filter("rule = 'duplicate-code'").collect()
    assert [r.file for r in one] == ["b.php"]


def test_own_rule(spark, project):
    def shouting(fs, nodes):
        return fs.filter(F.upper("source") == F.col("source")).select("file", F.lit(1).alias("line"), F.lit("shouting").alias("rule"), F.lit("info").alias("severity"), F.lit("all upper case").alias("message"))

    (project / "u.txt").write_text("ABC\n")
    a = Engine(spark).with_rule("shouting", shouting).analyze_path(str(project))
    assert [os.path.basename(r.file) for r in a.findings.filter("rule = 'shouting'").collect()] == ["u.txt"]
    first = [r.file for r in post.ordered(a.findings).collect()]
    assert first == sorted(first)


def test_own_language(spark, project):
    def words(text):
        if "?" in text:
            raise trees.ParseError("a question")
        return trees.Node("Root", 1, [trees.Node("FunctionDecl", 1, [trees.Node("Block", 1)], name=text.strip())])

    (project / "w.words").write_text("hello\n")
    (project / "q.words").write_text("why?\n")
    a = Engine(spark).with_provider(files.Provider("Words", (".words",), words)).analyze_path(str(project))
    got = {(os.path.basename(r.file), r.rule) for r in a.findings.collect() if r.file.endswith(".words")}
    assert got == {("w.words", "empty-function"), ("q.words", "parse-error")}
    assert {r.language for r in a.results.collect()} >= {"Words", "PHP"}


def test_empty_folder(spark, tmp_path):
    (tmp_path / "x").mkdir()
    a = Engine(spark).analyze_path(str(tmp_path / "x"))
    assert a.findings.count() == 0 and a.results.count() == 0


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.php").write_text("<?php // TODO: x\n")
    q = stream.to_table(stream.read_files(spark, str(src)), str(out), str(tmp_path / "ck"), stream.text_findings)
    q.awaitTermination(60)
    time.sleep(1)
    (src / "b.php").write_text("<?php // FIXME: y\n")
    stream.to_table(stream.read_files(spark, str(src)), str(out), str(tmp_path / "ck"), stream.text_findings).awaitTermination(60)
    assert sorted(r.message for r in spark.read.parquet(str(out)).collect()) == ["FIXME: y", "TODO: x"]


def test_windowed_counts(spark):
    rows = [("2026-01-01 00:01:00", "a"), ("2026-01-01 00:09:59", "a"), ("2026-01-01 00:10:00", "a"), ("2026-01-01 00:05:00", "b"), (None, "a")]
    df = spark.createDataFrame(rows, "at string, rule string").withColumn("at", F.to_timestamp("at"))
    got = sorted((str(r.window_start)[11:16], r.rule, r.findings) for r in stream.findings_per_window(df, "at").collect())
    assert got == [("00:00", "a", 2), ("00:00", "b", 1), ("00:10", "a", 1)]


def test_structural_stream_rules_on_a_batch(spark):
    f = files.from_table(spark.createDataFrame([("a.js", "function f() { }\n"), ("b.js", "let a = (")], "file string, source string"), F.col("file"), F.col("source"))
    assert [(r.file, r.rule) for r in stream.structural_findings(f).collect()] == [("a.js", "empty-function")]


def test_own_rules_take_options_and_severities(spark, project):
    from treeline.sources import config

    def long_path(files, nodes, most):
        from pyspark.sql import functions as F

        return files.filter(F.length("file") > most).select("file", F.lit(1).alias("line"), F.lit("long-path").alias("rule"), F.lit("info").alias("severity"), F.lit("long").alias("message"))

    engine = Engine(spark).with_rule("long-path", long_path, most=(10_000, 1))
    count = lambda e: e.analyze_path(str(project)).findings.filter("rule = 'long-path'").groupBy("severity").count().collect()
    assert count(engine) == []
    got = count(engine.with_config(config.read({"rules": {"long-path": {"severity": "error", "most": 1}}}, ".")))
    assert len(got) == 1 and got[0].severity == "error"
    assert count(engine.with_config(config.read({"rules": {"long-path": "off"}}, "."))) == []
    for bad in ({"long-path": {"least": 1}}, {"long-path": {"most": 0}}, {"other": "off"}):
        with pytest.raises(config.ConfigError):
            engine.with_config(config.read({"rules": bad}, "."))


@pytest.mark.parametrize("most", [256, 1])
def test_listing_goes_on_where_files_are_read(spark, project, monkeypatch, most):
    monkeypatch.setattr(files, "DRIVER_DIRS", most)
    (project / "src" / "deep" / "er").mkdir(parents=True)
    (project / "src" / "deep" / "er" / "x.php").write_text("<?php\n")
    (project / "src" / "deep" / "no.php").write_text("<?php\n")
    got = sorted(os.path.relpath(r.file, project) for r in files.scan_files(spark, str(project), ["src/deep/no.php"]).select("file").collect())
    assert got == sorted(os.path.relpath(p, project) for p in files.list_files(str(project), ["src/deep/no.php"])) and "src/deep/er/x.php" in got
    with pytest.raises(FileNotFoundError):
        files.scan_files(spark, str(project / "none"))


@pytest.mark.parametrize("kind", ["json", "sarif", "checkstyle"])
def test_findings_are_written_by_partition(spark, project, tmp_path, kind):
    a = Engine(spark).analyze_path(str(project))
    out = tmp_path / "parts"
    assert cli.main([str(project), "--output-dir", str(out), *([f"--{kind}"] if kind != "json" else [])]) == 1
    texts = [p.read_text() for p in sorted(out.glob("part-*")) if p.stat().st_size]
    n = a.findings.count()
    if kind == "json":
        rows = [json.loads(x) for t in texts for x in t.splitlines()]
        assert len(rows) == n and all("fix" in r for r in rows)
    elif kind == "sarif":
        assert sum(len(json.loads(t)["runs"][0]["results"]) for t in texts) == n
    else:
        assert sum(t.count("<error ") for t in texts) == n
    a.release()
    assert a.findings.count() == n
    with pytest.raises(ValueError, match="other"):
        formats.write_parts(a.findings, "other", str(out), ".")
