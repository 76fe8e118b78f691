"""The project report: aggregates over results(file, language, lines_of_code, functions) and
findings(file, line, end_line, rule, severity, message). Each section is one DataFrame.

Defined results: a file without language and code counts nowhere; null sums are 0; a null language is
'other'; functions of a null list are none; a null or smaller end line means one line; ties in top lists are
broken by file and line; empty tables give zeros or no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP = 10


def counted(results: DataFrame) -> DataFrame:
    """Files with a language or with code."""
    return results.filter("language is not null or coalesce(lines_of_code, 0) > 0")


def summary(results: DataFrame, findings: DataFrame) -> DataFrame:
    """(files, lines_of_code, functions, findings): one row."""
    r = counted(results).agg(F.count("*").alias("files"), F.coalesce(F.sum("lines_of_code"), F.lit(0)).alias("lines_of_code"), F.coalesce(F.sum(F.coalesce(F.size("functions"), F.lit(0))), F.lit(0)).alias("functions"))
    n = findings.agg(F.count("*").alias("findings"))
    return r.join(F.broadcast(n))


def languages(results: DataFrame) -> DataFrame:
    return counted(results).groupBy(F.coalesce("language", F.lit("other")).alias("language")).agg(F.count("*").alias("files"), F.coalesce(F.sum("lines_of_code"), F.lit(0)).alias("lines_of_code")).orderBy(F.desc("lines_of_code"), "language")


def severities(findings: DataFrame) -> DataFrame:
    """(error, warning, info): one row of counts."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warning", "info")])


def rules(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "rule")


def complex_functions(results: DataFrame, top: int = TOP) -> DataFrame:
    f = counted(results).select("file", F.explode("functions").alias("f")).select("file", "f.line", "f.name", "f.cognitive", "f.cyclomatic", "f.statements").filter("cognitive > 0")
    return f.orderBy(F.desc("cognitive"), F.desc("cyclomatic"), "file", "line", "name", "statements").limit(top)


def _of_counted(results: DataFrame, findings: DataFrame) -> DataFrame:
    return findings.join(counted(results).select("file").distinct(), "file", "left_semi")


def hotspots(results: DataFrame, findings: DataFrame, top: int = TOP) -> DataFrame:
    """Files by 3 * errors + warnings. Findings are summed per file before anything is joined."""
    per = findings.groupBy("file").agg(*[F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "info"))]).withColumn("score", 3 * F.col("errors") + F.col("warnings")).filter("score > 0")
    loc = counted(results).groupBy("file").agg(F.coalesce(F.max("lines_of_code"), F.lit(0)).alias("lines_of_code"))
    return per.join(loc, "file").select("file", "score", "errors", "warnings", "info", "lines_of_code").orderBy(F.desc("score"), "file").limit(top)


def duplicated_lines(results: DataFrame, findings: DataFrame) -> DataFrame:
    """(file, fragments, duplicated_lines): lines that duplicate findings cover, each once."""
    d = _of_counted(results, findings.filter("rule = 'duplicate-code' and line is not null"))
    span = d.select("file", F.explode(F.sequence("line", F.greatest("line", F.coalesce("end_line", "line")))).alias("n"))
    lines = span.groupBy("file").agg(F.count_distinct("n").alias("duplicated_lines"))
    return d.groupBy("file").agg(F.count("*").alias("fragments")).join(lines, "file")


def duplication(results: DataFrame, findings: DataFrame) -> DataFrame:
    """(fragments, duplicated_lines, percent): one row."""
    per = duplicated_lines(results, findings).agg(F.coalesce(F.sum("fragments"), F.lit(0)).alias("fragments"), F.coalesce(F.sum("duplicated_lines"), F.lit(0)).alias("duplicated_lines"))
    loc = counted(results).agg(F.coalesce(F.sum("lines_of_code"), F.lit(0)).alias("loc"))
    percent = F.when(F.col("loc") > 0, F.least(F.lit(100.0), F.round(100.0 * F.col("duplicated_lines") / F.col("loc"), 1))).otherwise(0.0)
    return per.join(F.broadcast(loc)).select("fragments", "duplicated_lines", percent.alias("percent"))


def duplication_files(results: DataFrame, findings: DataFrame, top: int = TOP) -> DataFrame:
    return duplicated_lines(results, findings).select("file", "duplicated_lines").orderBy(F.desc("duplicated_lines"), "file").limit(top)
