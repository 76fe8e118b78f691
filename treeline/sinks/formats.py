"""Findings as text, JSON, Checkstyle XML, SARIF and CI annotations.

Formats read findings in their contractual order, one partition at a time, into one text; ``write_parts``
writes a file per partition instead, where findings are too many for that.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from types import SimpleNamespace
from urllib.parse import quote
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from treeline import __version__
from treeline.operators import post

ICONS = {"error": "x", "warning": "!", "info": "i"}


def rows(findings: DataFrame) -> Iterable[Row]:
    return post.ordered(findings).toLocalIterator()


def as_text(found: Iterable[Row]) -> str:
    out, n = [], 0
    for r in found:
        out.append(f"{ICONS.get(r.severity, '?')} {r.file}:{r.line} [{r.rule}] {r.message}")
        n += 1
    out.append(f"{n} finding{'' if n == 1 else 's'}." if n else "No findings.")
    return "\n".join(out) + "\n"


def as_json(found: Iterable[Row]) -> str:
    items = []
    for r in found:
        fix = r.fix and {"startOffset": r.fix.start_offset, "endOffset": r.fix.end_offset, "replacement": r.fix.replacement}
        items.append({"file": r.file, "line": r.line, "rule": r.rule, "severity": r.severity, "message": r.message, "fix": fix})
    return json.dumps({"ok": not items, "findings": items}, ensure_ascii=False, indent=4).replace("/", "\\/") + "\n"


def as_checkstyle(found: Iterable[Row]) -> str:
    root = ET.Element("checkstyle", version="8.0")
    file = None
    for r in found:
        if file is None or file.get("name") != r.file:
            file = ET.SubElement(root, "file", name=r.file)
        ET.SubElement(file, "error", line=str(r.line), severity=r.severity, message=r.message, source=f"treeline.{r.rule}")
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode") + "\n"


def uri(path: str, base: str) -> str:
    """Relative and per cent encoded below ``base``; a file address elsewhere."""
    plain, root = path.replace("\\", "/"), base.replace("\\", "/").rstrip("/") + "/"
    if plain.startswith(root):
        return quote(plain[len(root) :], safe="/~")
    encoded = quote(plain, safe="/~:")
    return f"file://{encoded}" if plain.startswith("/") else encoded


def as_sarif(found: Iterable[Row], base: str) -> str:
    found = list(found)
    rules = sorted({r.rule for r in found})
    index = {r: k for k, r in enumerate(rules)}
    results = []
    for r in found:
        region = {"startLine": max(1, r.line)}
        if r.end_line is not None:
            region["endLine"] = max(1, r.end_line)
        results.append(
            {
                "ruleId": r.rule, "ruleIndex": index[r.rule], "level": {"error": "error", "warning": "warning"}.get(r.severity, "note"), "message": {"text": r.message},
                "locations": [{"physicalLocation": {"artifactLocation": {"uri": uri(r.file, base)}, "region": region}}],
            }
        )
    driver = {"name": "treeline", "version": __version__, "rules": [{"id": r} for r in rules]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]}, ensure_ascii=False, indent=2) + "\n"


def write_parts(findings: DataFrame, kind: str, path: str, base: str) -> None:
    """Findings as a folder of files, one per partition, written by the executors: ``json`` (a finding a line), ``sarif``
    (a whole log in each file) or ``checkstyle``. Files are split by path, so one file's findings stand together and in order."""
    rows_ = findings.repartitionByRange("file").sortWithinPartitions(*post.ORDER)
    if kind == "json":
        fix = F.when(F.col("fix").isNotNull(), F.struct(F.col("fix.start_offset").alias("startOffset"), F.col("fix.end_offset").alias("endOffset"), F.col("fix.replacement").alias("replacement")))
        rows_.select("file", "line", "rule", "severity", "message", fix.alias("fix")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
        return

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [SimpleNamespace(**r) for pdf in batches for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records")]
        if found:
            text = as_sarif(found, base) if kind == "sarif" else as_checkstyle(found)
            yield pd.DataFrame({"value": [text.rstrip("\n")]})

    if kind not in ("sarif", "checkstyle"):
        raise ValueError(kind)
    rows_.select("file", "line", "rule", "severity", "message", "end_line").mapInPandas(part, "value string").write.mode("overwrite").text(path)


def as_annotations(findings: DataFrame, base: str) -> str:
    lines = post.github_annotations(post.ordered(findings), os.path.realpath(base)).select("annotation").toLocalIterator()
    return "".join(r.annotation + "\n" for r in lines)
