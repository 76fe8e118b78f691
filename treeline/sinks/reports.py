"""The project report as a model, text, JSON and one self-contained HTML page."""

from __future__ import annotations

import html
import json
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions import text as T
from treeline.operators import post, report


def build(results: DataFrame, findings: DataFrame, base: str) -> dict:
    """All sections. Each is an aggregate or a top list; only ``findings`` is as long as they are."""
    rel = lambda df: df.withColumn("file", T.relative(F.col("file"), base))
    rows = lambda df, **names: [{names.get(k, k): v for k, v in r.asDict().items()} for r in df.toLocalIterator()]
    r, f = rel(results), rel(findings)
    s = report.summary(r, f).first()
    d = report.duplication(r, f).first()
    return {
        "summary": {"files": s.files, "linesOfCode": s.lines_of_code, "functions": s.functions, "findings": s.findings},
        "languages": rows(report.languages(r), lines_of_code="linesOfCode"),
        "severities": report.severities(f).first().asDict(),
        "rules": rows(report.rules(f)),
        "complexFunctions": rows(report.complex_functions(r)),
        "hotspots": rows(report.hotspots(r, f), lines_of_code="linesOfCode"),
        "duplication": {"fragments": d.fragments, "duplicatedLines": d.duplicated_lines, "percent": d.percent, "files": rows(report.duplication_files(r, f), duplicated_lines="duplicatedLines")},
        "findings": rows(post.ordered(f).select("file", "line", "rule", "severity", "message")),
    }


def as_json(model: dict) -> str:
    return json.dumps(model, ensure_ascii=False, indent=4) + "\n"


def as_text(model: dict) -> str:
    s, out = model["summary"], ["Project report", "=" * 14, ""]
    out += [f"Files: {s['files']}   Lines of code: {s['linesOfCode']}   Functions: {s['functions']}   Findings: {s['findings']}", ""]

    def section(title: str, lines: list[str]) -> None:
        if lines:
            out.extend([title, "-" * len(title), *lines, ""])

    section("Languages", [f"  {x['language']:<16}{x['files']:>6} files {x['linesOfCode']:>9} lines" for x in model["languages"]])
    section("Severities", [f"  {k:<10}{model['severities'][k]:>6}" for k in ("error", "warning", "info")])
    section("Rules", [f"  {x['rule']:<28}{x['count']:>6}" for x in model["rules"]])
    section("Most complex functions", [f"  {x['cognitive']:>4} cognitive {x['cyclomatic']:>4} cyclomatic  {x['name']}  {x['file']}:{x['line']}" for x in model["complexFunctions"]])
    section("Hotspots", [f"  {x['score']:>5}  {x['file']} ({x['errors']} errors, {x['warnings']} warnings)" for x in model["hotspots"]])
    d = model["duplication"]
    section("Duplication", [f"  {d['fragments']} fragments, {d['duplicatedLines']} lines, {d['percent']} %", *[f"  {x['duplicatedLines']:>6}  {x['file']}" for x in d["files"]]])
    return "\n".join(out)


_STYLE = (
    "body{font:15px/1.45 system-ui,sans-serif;margin:2rem auto;max-width:64rem;padding:0 1rem;color:#222}.tiles{display:flex;gap:1rem;flex-wrap:wrap}.tile{border:1px solid #ccc;border-radius:.5rem;padding:.6rem 1rem}"
    ".tile b{display:block;font-size:1.5rem}table{border-collapse:collapse;width:100%}td,th{text-align:left;padding:.2rem .6rem;border-bottom:1px solid #eee}.bar{background:#4a7;height:.7rem;border-radius:.2rem}.error{color:#b00}.warning{color:#a60}.info{color:#357}"
)


def as_html(model: dict) -> str:
    e = lambda x: html.escape(str(x), quote=True)

    def table(head: list[str], lines: list[list[object]]) -> str:
        if not lines:
            return "<p>None.</p>"
        return "<table><tr>" + "".join(f"<th>{e(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in lines) + "</table>"

    def bars(items: list[tuple[object, int]]) -> str:
        most = max([n for _, n in items], default=0) or 1
        return table(["", "", ""], [[e(name), n, f'<div class="bar" style="width:{round(100 * n / most)}%"></div>'] for name, n in items])

    s, d = model["summary"], model["duplication"]
    tiles = "".join(f'<div class="tile"><b>{e(v)}</b>{e(k)}</div>' for k, v in (("files", s["files"]), ("lines of code", s["linesOfCode"]), ("functions", s["functions"]), ("findings", s["findings"]), ("% duplicated", d["percent"])))
    per: dict[str, list[dict]] = defaultdict(list)
    for f in model["findings"]:
        per[f["file"]].append(f)
    details = "".join(
        f"<details><summary>{e(file)} ({len(fs)})</summary>" + table(["line", "severity", "rule", "message"], [[f["line"], f'<span class="{e(f["severity"])}">{e(f["severity"])}</span>', e(f["rule"]), e(f["message"])] for f in fs]) + "</details>" for file, fs in per.items()
    )
    return (
        f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Project report</title><style>{_STYLE}</style></head><body><h1>Project report</h1><div class="tiles">{tiles}</div>'
        f"<h2>Languages</h2>{bars([(x['language'], x['linesOfCode']) for x in model['languages']])}<h2>Severities</h2>{bars([(k, model['severities'][k]) for k in ('error', 'warning', 'info')])}"
        f"<h2>Rules</h2>{bars([(x['rule'], x['count']) for x in model['rules']])}"
        f"<h2>Most complex functions</h2>{table(['function', 'file', 'cognitive', 'cyclomatic', 'statements'], [[e(x['name']), e(x['file']) + ':' + str(x['line']), x['cognitive'], x['cyclomatic'], x['statements']] for x in model['complexFunctions']])}"
        f"<h2>Hotspots</h2>{table(['file', 'score', 'errors', 'warnings', 'info'], [[e(x['file']), x['score'], x['errors'], x['warnings'], x['info']] for x in model['hotspots']])}"
        f"<h2>Duplication</h2><p>{d['fragments']} fragments, {d['duplicatedLines']} lines</p>{table(['file', 'lines'], [[e(x['file']), x['duplicatedLines']] for x in d['files']])}"
        f"<h2>Findings</h2>{details or '<p>None.</p>'}</body></html>\n"
    )
