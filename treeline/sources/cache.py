"""Results of earlier runs as a parquet table keyed by path and content.

A run probes the table with an anti join, parses only what missed, and writes back what it
used. A table of another format, version or rule options isn't used. Files that couldn't
be read or parsed are never kept.

All files are reached through Hadoop's file systems, as the executors reach the table. Each run writes a
table of its own beside the one it reads and then points to it; the one it read stays until the run after,
as a lost executor may have to read it again.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import treeline
from treeline.functions import text as T

FORMAT = 2
POINTER = "_current"


def fingerprint(options: dict) -> str:
    return hashlib.sha1(json.dumps([FORMAT, treeline.__version__, options], sort_keys=True).encode()).hexdigest()


def keyed(files: DataFrame) -> DataFrame:
    return files.withColumn("key", T.cache_key(F.col("file"), F.coalesce("content", F.encode("source", "UTF-8")) if "content" in files.columns else F.encode("source", "UTF-8")))


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    """(file system, path) of Hadoop."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def pointer(spark: SparkSession, path: str) -> dict:
    """What the pointer says: ``mark`` and ``table``, and the table ``before``; empty if there is none that can be read."""
    fs, p = _at(spark, f"{path}/{POINTER}")
    if not fs.exists(p):
        return {}
    stream = fs.open(p)
    try:
        said = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except (ValueError, Py4JJavaError):
        return {}
    finally:
        stream.close()
    return said if isinstance(said, dict) else {}


def load(spark: SparkSession, path: str, mark: str) -> DataFrame | None:
    """The cached rows, or None if there are none that may be used."""
    said = pointer(spark, path)
    if said.get("mark") != mark:
        return None
    try:
        return spark.read.parquet(f"{path}/{said['table']}")
    except (AnalysisException, KeyError):  # a broken cache is no cache
        return None


def split(files: DataFrame, cached: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(files to parse, cached rows of the others)."""
    k = keyed(files)
    if cached is None:
        return k, None
    return k.join(cached.select("key"), "key", "left_anti"), cached.join(k.select("key").distinct(), "key", "left_semi")


def save(rows: DataFrame, path: str, mark: str) -> None:
    """Writes a table and points to it; the table before the last one goes."""
    spark = rows.sparkSession
    said = pointer(spark, path)
    name = f"rows-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    fs, p = _at(spark, f"{path}/{POINTER}")
    stream = fs.create(p, True)
    stream.write(bytearray(json.dumps({"mark": mark, "table": name, "before": said.get("table")}).encode()))
    stream.close()
    if said.get("before"):
        fs, old = _at(spark, f"{path}/{said['before']}")
        fs.delete(old, True)
