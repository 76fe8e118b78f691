"""Streams of files: per-file rules over what arrives, and windowed counts of findings.

Rules that look at the whole project (duplicates) stay batch operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treeline.functions import text as T
from treeline.operators import rules, tree
from treeline.sources import files as S


def read_files(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """New files below a directory as files(file, source, language, arrived)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
    return raw.select(F.col("path").alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("source"), T.language_of(F.col("path"), S.LANGUAGE_NAMES).alias("language"), F.col("modificationTime").alias("arrived"))


def text_findings(files: DataFrame) -> DataFrame:
    """Findings of the textual rules; stateless, so any trigger gives the same rows."""
    return rules.todo_tracker(files).unionByName(rules.hardcoded_secret(files))


def structural_findings(files: DataFrame) -> DataFrame:
    """Findings that one file's tree decides by itself without grouping."""
    n = S.node_rows(S.parse_files(files, want=("node",)))
    return tree.deep_nesting(n).unionByName(tree.empty_catch(n)).unionByName(tree.empty_function(n)).unionByName(tree.empty_block(n)).unionByName(tree.long_function(n))


def findings_per_window(findings: DataFrame, at: str, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window_start, rule, findings): tumbling counts; rows later than ``late`` are dropped."""
    w = findings.withWatermark(at, late).groupBy(F.window(at, length).alias("w"), "rule").agg(F.count("*").alias("findings"))
    return w.select(F.col("w.start").alias("window_start"), "rule", "findings")


def to_table(findings: DataFrame, path: str, checkpoint: str, analyse: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Appends each micro-batch's findings to a parquet table, once per batch id."""

    def write(batch: DataFrame, number: int) -> None:
        out = analyse(batch) if analyse else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return findings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
