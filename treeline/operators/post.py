"""What happens to findings after the rules: suppression, severities, baseline, order.

Defined results: a null source has no directives; a null file, rule or message matches no directive and no
baseline entry, so such findings stay; a null baseline count is 1 and entries with one key add up; equal
findings are told apart by the given order only; a finding without a fix is no fix; columns beyond the named
ones are kept by suppression, severities and baseline.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.cluster import cut, join_small, ranked
from treeline.functions import text as T
from treeline.operators.rules import line_rows
from treeline.schemas import FIX

#: The word that directives begin with, and other spellings that are read too.
PREFIX = "treeline"

# Fixed value: what a directive may stand behind.
_COMMENT = r"(?d)(?://+|#+|/\*+|(?<![\w*])\*|--|;+|<!--)\s*"


def suppressions(files: DataFrame, prefixes: Sequence[str] = (PREFIX,)) -> DataFrame:
    """(file, scope, line, rule): what each directive switches off; a null rule means all.

    ``PREFIX-disable-line``, ``-next-line`` and ``-file`` take rule names; without a valid
    one they mean all rules. ``PREFIX:ignore`` anywhere switches its own line off."""
    marks = [m for p in prefixes for m in (f"{p}-disable-", f"{p}:ignore")]
    has = F.lit(False)
    for m in marks:
        has = has | F.contains("source", F.lit(m))
    rows = line_rows(files.filter(has))
    name = "|".join(T.fixed(p) for p in prefixes)
    rx = rf"{_COMMENT}(?:{name})-disable-(next-line|line|file)(?![A-Za-z0-9_])(.*)$"
    hit = rows.filter(F.col("text").rlike(rx)).withColumn("kind", F.regexp_extract("text", rx, 1)).withColumn("rest", F.regexp_extract("text", rx, 2))
    rest = F.split("rest", " -- ", 2)[0]
    rest = F.replace(F.replace(rest, F.lit("*/"), F.lit(" ")), F.lit("-->"), F.lit(" "))
    names = F.filter(F.split(rest, r"[\s,]+"), lambda x: x.rlike("^[a-z0-9][a-z0-9-]*$"))
    hit = hit.select("file", F.when(F.col("kind") == "file", "file").otherwise("line").alias("scope"), (F.col("line") + F.when(F.col("kind") == "next-line", 1).otherwise(0)).alias("line"), F.explode_outer(names).alias("rule"))
    ignore = F.lit(False)
    for p in prefixes:
        ignore = ignore | F.contains("text", F.lit(f"{p}:ignore"))
    legacy = rows.filter(ignore).select("file", F.lit("line").alias("scope"), "line", F.lit(None).cast("string").alias("rule"))
    return hit.unionByName(legacy).withColumn("line", F.when(F.col("scope") == "file", 0).otherwise(F.col("line"))).distinct()


def suppress(findings: DataFrame, off: DataFrame) -> DataFrame:
    """Findings that no directive covers.

    Directives become one small row per file and line (which rules, or all), so that two
    equi-joins decide; those sides are broadcast only while they are small."""
    by = cut(off.groupBy("file", "scope", "line").agg(F.max(F.col("rule").isNull()).alias("all"), F.collect_set("rule").alias("rules")))
    lines = by.filter("scope = 'line'").select("file", "line", F.col("all").alias("_la"), F.col("rules").alias("_lr"))
    whole = by.filter("scope = 'file'").select("file", F.col("all").alias("_fa"), F.col("rules").alias("_fr"))
    both = join_small(join_small(findings, lines, ["file", "line"], "left"), whole, ["file"], "left")
    covered = F.coalesce(F.col("_la") | F.array_contains("_lr", F.col("rule")), F.lit(False)) | F.coalesce(F.col("_fa") | F.array_contains("_fr", F.col("rule")), F.lit(False))
    return both.filter(~covered).select(*findings.columns)


def override_severity(findings: DataFrame, severities: Mapping[str, str | None]) -> DataFrame:
    """Severities from the configuration; None drops the rule's findings."""
    if not severities:
        return findings
    off = [r for r, s in severities.items() if s is None]
    out = findings.filter(~F.col("rule").isin(*off)) if off else findings
    new = {r: s for r, s in severities.items() if s is not None}
    if not new:
        return out
    table = F.create_map(*[F.lit(x) for pair in new.items() for x in pair])
    return out.withColumn("severity", F.coalesce(table[F.col("rule")], F.col("severity")))


def create_baseline(findings: DataFrame) -> DataFrame:
    """(file, rule, message, count)."""
    return findings.groupBy("file", "rule", "message").agg(F.count("*").alias("count"))


def apply_baseline(findings: DataFrame, baseline: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Findings beyond those that the baseline knows.

    Of each (file, rule, message) the first ``count`` in the given order are hidden: a
    multiset difference. Only keys that the baseline knows are numbered, and a key may hold
    any part of all findings."""
    known = baseline.groupBy("file", "rule", "message").agg(F.sum(F.coalesce("count", F.lit(1))).alias("_n"))
    keys = ["file", "rule", "message"]
    marked = cut(join_small(findings, cut(known), keys, "left"))
    fresh = marked.filter("_n is null").select(*findings.columns)
    numbered = ranked(marked.filter("_n is not null"), keys, [F.col(c) if isinstance(c, str) else c for c in order], "_k")
    return fresh.unionByName(numbered.filter("_k > _n").select(*findings.columns))


#: The contractual order of findings.
ORDER = ("file", "phase", "rule_ord", "k1", "k2")


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*ORDER)


def select_fixes(findings: DataFrame, size: Column | None = None) -> DataFrame:
    """(file, fixes): the fixes that don't overlap, from the end of each file to its start.

    Taken greedily by start, the greatest first; of equal starts the finding that stands first."""
    f = findings.filter("fix is not null")
    one = F.struct((-F.col("fix.start_offset")).alias("s"), F.col("k").alias("k"), F.col("fix.end_offset").alias("e"), F.col("fix.replacement").alias("r"))
    limit = F.lit((1 << 31) - 1) if size is None else size
    per = f.groupBy("file").agg(F.sort_array(F.collect_list(one)).alias("all"), F.max(limit).cast("long").alias("limit"))
    arrays = per.select("file", "limit", F.col("all.s").alias("s"), F.col("all.e").alias("e"), F.col("all.r").alias("r"))
    return arrays.mapInArrow(_greedy, f"file string, fixes array<{FIX}>")


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over the fixes of each file, so that a file with many of them costs no more a fix."""
    kind = pa.list_(pa.struct([("start_offset", pa.int32()), ("end_offset", pa.int32()), ("replacement", pa.string())]))
    for batch in batches:
        files, chosen = [], []
        for file, limit, starts, ends, texts in zip(*(c.to_pylist() for c in batch.columns)):
            got = []
            for s, e, r in zip(starts, ends, texts):
                if s is not None and e is not None and 0 <= -s <= e <= limit:
                    got.append({"start_offset": -s, "end_offset": e, "replacement": r})
                    limit = -s
            files.append(file)
            chosen.append(got)
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(chosen, kind)], names=["file", "fixes"])


def github_annotations(findings: DataFrame, base: str = "", tool: str = PREFIX) -> DataFrame:
    """(file, line, rule, annotation): workflow commands of a CI service."""
    path = T.relative(F.col("file"), base) if base else F.col("file")
    end = F.when(F.col("end_line").isNotNull(), F.concat(F.lit(",endLine="), F.greatest(F.lit(1), F.col("end_line")).cast("string"))).otherwise(F.lit(""))
    text = F.concat(
        F.lit("::"), T.severity_level(F.col("severity"), "annotation"), F.lit(" file="), T.escape_property(path), F.lit(",line="), F.greatest(F.lit(1), F.col("line")).cast("string"), end,
        F.lit(",title="), T.escape_property(F.concat(F.lit(tool + " "), F.col("rule"))), F.lit("::"), T.escape_data(F.col("message")),
    )
    return findings.select("file", "line", "rule", text.alias("annotation"))
