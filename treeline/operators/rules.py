"""Textual rules over files(file, source): one pass over each file's lines inside the JVM.

Defined results: a null or empty source has no findings; repeated files give repeated findings; other
columns are ignored; a null file is kept as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import text as T

# Fixed value: what counts as a note in a comment. (?d) keeps '.' and '$' at LF only; the class after TODO is an ASCII word boundary.
TODO = r"(?id)(?<!http:)(?<!https:)(?://|#|/\*|--)\s*(TODO|FIXME)(?![A-Za-z0-9_])[:\s]*(.*)"

# Shapes of issued tokens, and names whose quoted value is a secret.
SECRET = (
    r"gh[pousr]_[A-Za-z0-9]{36}|AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"|(?i:password|passwd|secret|api_?key|token)\s*[:=]+\s*[\"'][^\"'\s]{8,}[\"']"
)


def line_rows(files: DataFrame) -> DataFrame:
    """(file, line, text): 1-based."""
    return files.select("file", F.posexplode(T.lines(F.col("source"))).alias("pos", "text")).select("file", (F.col("pos") + 1).alias("line"), "text")


def _rows(df: DataFrame, rule: str, severity: str, message: Column) -> DataFrame:
    return df.select("file", "line", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"), F.col("line").alias("k1"), F.lit(0).alias("k2"))


def todo_tracker(files: DataFrame) -> DataFrame:
    """Notes left in comments; the cheap test for the word comes before lines are split."""
    some = line_rows(files.filter(F.col("source").rlike("(?i)todo|fixme"))).filter(F.col("text").rlike(TODO))
    note = F.btrim(F.regexp_extract("text", TODO, 2), F.lit(T.TRIMMED))
    word = F.upper(F.regexp_extract("text", TODO, 1))
    return _rows(some, "todo-tracker", "info", F.when(note == "", word).otherwise(F.concat(word, F.lit(": "), note)))


def windows_script_encoding(files: DataFrame) -> DataFrame:
    """Script files that Windows reads wrongly: .ps1 without a mark, .bat and .cmd with any non-ASCII text.

    ``content`` (bytes) is used for the mark when there is such a column."""
    ext = T.extension(F.col("file"))
    bom = T.has_bom(F.col("content")) if "content" in files.columns else F.startswith(F.col("source"), F.lit("\ufeff"))
    e = files.filter(ext.isin("ps1", "bat", "cmd")).withColumn("line", T.first_non_ascii_line(F.col("source")).cast("int")).filter("line > 0").withColumn("ext", ext).filter(~((F.col("ext") == "ps1") & bom))
    message = F.when(F.col("ext") == "ps1", F.lit("Non-ASCII text without a byte order mark is read in the system's code page.")).otherwise(F.lit("Non-ASCII text is read in the system's code page."))
    return _rows(e, "windows-script-encoding", "error", message)


def hardcoded_secret(files: DataFrame) -> DataFrame:
    some = line_rows(files.filter(F.col("source").rlike(SECRET))).filter(F.col("text").rlike(SECRET))
    return _rows(some, "hardcoded-secret", "error", F.lit("A secret is written in the code."))
