"""Command line: ``python -m treeline.cli <path> [options]`` and ``... report <path>``.

Exit codes: 0 nothing found (or a report was made), 1 findings, 2 wrong use or configuration.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from treeline.engine import Engine
from treeline.functions import text as T
from treeline.operators import post
from treeline.sinks import fixer, formats, reports
from treeline.sources import baseline, config

FLAGS = ("--json", "--sarif", "--checkstyle", "--github", "--fix", "--no-todo", "--no-config")
VALUES = ("--config", "--baseline", "--create-baseline", "--format", "--output", "--cache", "--jobs", "--suppress-prefix", "--output-dir")
USAGE = "usage: treeline [report] PATH [--json|--sarif|--checkstyle|--github] [--fix] [--no-todo] [--config FILE] [--baseline FILE] [--create-baseline FILE] [--cache DIR] [--jobs N|auto] [--format text|json|html] [--output FILE] [--output-dir DIR]"


class Usage(ValueError):
    """The command line makes no sense."""


def arguments(argv: list[str]) -> tuple[list[str], dict[str, str | bool]]:
    """Paths and options; unknown options are ignored."""
    paths, opts, k = [], {}, 0
    while k < len(argv):
        a = argv[k]
        name, eq, value = a.partition("=")
        if name in VALUES:
            if not eq:
                k += 1
                if k >= len(argv):
                    raise Usage(f"{name} needs a value")
                value = argv[k]
            opts[name] = value
        elif a in FLAGS:
            opts[a] = True
        elif not a.startswith("--"):
            paths.append(a)
        k += 1
    return paths, opts


def validate(paths: list[str], opts: dict[str, str | bool]) -> tuple[bool, str]:
    is_report = bool(paths) and paths[0] == "report"
    rest = paths[1:] if is_report else paths
    if not rest:
        raise Usage(USAGE)
    if not is_report and ("--format" in opts or "--output" in opts):
        raise Usage("--format and --output belong to report")
    if is_report and any(x in opts for x in ("--fix", "--baseline", "--create-baseline", "--json", "--sarif", "--checkstyle", "--github")):
        raise Usage("report takes --format and --output only")
    if opts.get("--format", "text") not in ("text", "json", "html"):
        raise Usage("--format must be text, json or html")
    jobs = opts.get("--jobs", "auto")
    if jobs != "auto" and not (str(jobs).isdigit() and int(jobs) >= 1):
        raise Usage("--jobs must be a whole number of at least 1, or auto")
    return is_report, rest[0]


def session(jobs: str) -> SparkSession:
    active = SparkSession.getActiveSession()
    if active:
        return active
    n = "*" if jobs == "auto" else jobs
    out = SparkSession.builder.master(f"local[{n}]").appName("treeline").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    return out


def write(text: str, output: str | bool | None) -> None:
    if not output:
        sys.stdout.write(text)
        return
    with open(str(output), "w", encoding="utf-8") as f:
        f.write(text)
    sys.stderr.write(f"Written to {output}\n")


def run(argv: list[str]) -> int:
    paths, opts = arguments(argv)
    is_report, path = validate(paths, opts)
    if not os.path.exists(path):
        raise Usage(f"{path} does not exist")
    conf = config.Config(base_dir=os.path.abspath(path) if os.path.isdir(path) else os.path.dirname(os.path.abspath(path)))
    where = opts.get("--config") or (None if opts.get("--no-config") else config.discover(path))
    if where:
        conf = config.load(str(where))
    spark = session(str(opts.get("--jobs", "auto")))
    prefixes = (post.PREFIX, *([str(opts["--suppress-prefix"])] if "--suppress-prefix" in opts else []))
    engine = Engine(spark, todo=not opts.get("--no-todo"), cache_path=opts.get("--cache") or None, prefixes=prefixes).with_config(conf)
    full = os.path.abspath(path)
    a = engine.analyze_path(full)
    base = conf.base_dir
    if is_report:
        model = reports.build(a.results, a.findings, base)
        kind = str(opts.get("--format", "text"))
        write({"text": reports.as_text, "json": reports.as_json, "html": reports.as_html}[kind](model), opts.get("--output"))
        return 0
    if opts.get("--fix"):
        n = fixer.apply(a.findings, a.files)
        sys.stderr.write(f"{n} fixes applied\n")
        spark.catalog.clearCache()
        a = engine.analyze_path(full)
    found = a.findings
    if "--create-baseline" in opts:
        n = baseline.save(post.create_baseline(found.withColumn("file", T.relative(F.col("file"), base))), str(opts["--create-baseline"]))
        sys.stderr.write(f"{n} entries written\n")
        return 0
    known = opts.get("--baseline") or conf.baseline
    if known:
        b = baseline.load(spark, str(known), must_exist="--baseline" in opts)
        rel = found.withColumn("_full", F.col("file")).withColumn("file", T.relative(F.col("file"), base))
        found = post.apply_baseline(rel, b, post.ORDER).withColumn("file", F.col("_full")).drop("_full")
    found = found.persist()
    any_found = not found.isEmpty()
    if "--output-dir" in opts:
        kind = next((k for k in ("sarif", "checkstyle") if opts.get(f"--{k}")), "json")
        formats.write_parts(found, kind, str(opts["--output-dir"]), base)
        return 1 if any_found else 0
    if opts.get("--github"):
        text = formats.as_annotations(found, base)
    elif opts.get("--sarif"):
        text = formats.as_sarif(formats.rows(found), base)
    elif opts.get("--checkstyle"):
        text = formats.as_checkstyle(formats.rows(found))
    elif opts.get("--json"):
        text = formats.as_json(formats.rows(found))
    else:
        text = formats.as_text(formats.rows(found))
    sys.stdout.write(text)
    return 1 if any_found else 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(sys.argv[1:] if argv is None else argv)
    except (Usage, config.ConfigError, FileNotFoundError, OSError) as e:
        sys.stderr.write(f"{e}\n")
        return 2


if __name__ == "__main__":
    sys.exit(main())
