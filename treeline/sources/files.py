"""Files as rows: a directory scan, tables of texts, and parsed trees.

``files`` has file, content (bytes), source (text), language, error. A file that can't be
read is a row with an error, never a failed task and never silently clean.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import text as T
from treeline.operators.tree import NODE_COLUMNS, arrow_schema, expand
from treeline.parsers import trees
from treeline.schemas import NODE
from treeline.sources.globs import SKIPPED, is_excluded

FILES = "file string, content binary, source string, language string, error string"
LANGUAGE_NAMES = [(la.name, la.extensions) for la in trees.LANGUAGES]


def list_files(root: str, exclude: list[str] | None = None, base: str | None = None) -> list[str]:
    """Paths below ``root`` in byte order. A root that is a file is taken as it is.

    Directories are skipped by name relative to the root. Raises FileNotFoundError."""
    exclude, base = exclude or [], base or root
    if os.path.isfile(root):
        rel = os.path.relpath(root, base if os.path.isdir(base) else os.path.dirname(root)).replace(os.sep, "/")
        return [] if is_excluded(rel, exclude) else [root]
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    out = []
    for where, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in SKIPPED]
        out += [p for n in names if not is_excluded(os.path.relpath(p := os.path.join(where, n), base).replace(os.sep, "/"), exclude)]
    return sorted(out, key=os.fsencode)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path in pdf["file"]:
            la = trees.language_for(path)
            try:
                with open(path, "rb") as f:
                    data = f.read()
                rows.append((path, data, data.decode("utf-8", "replace"), la.name if la else None, None))
            except OSError as e:
                rows.append((path, None, None, None, str(e)))
        yield pd.DataFrame(rows, columns=["file", "content", "source", "language", "error"])


#: Directories that the driver lists at most before the executors go on from there.
DRIVER_DIRS = 256


def _walk(batches: Iterator[pd.DataFrame], exclude: list[str], base: str) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for top, deep in zip(pdf["file"], pdf["deep"]):
            yield pd.DataFrame({"file": list_files(top, exclude, base) if deep else [top]})


def scan_files(spark: SparkSession, root: str, exclude: list[str] | None = None, base: str | None = None) -> DataFrame:
    """The files below a directory that all executors see.

    The driver lists the upper directories only, DRIVER_DIRS at most; what lies below is listed where it is read.
    Raises FileNotFoundError."""
    exclude, base = exclude or [], base or root
    found: list[tuple[str, bool]] = []
    if not os.path.isdir(root):
        found = [(p, False) for p in list_files(root, exclude, base)]
    todo, seen = ([root] if os.path.isdir(root) else []), 0
    while todo and seen < DRIVER_DIRS and len(todo) < DRIVER_DIRS:
        here, seen = todo.pop(0), seen + 1
        for entry in os.scandir(here):
            if entry.is_dir(follow_symlinks=False):
                if entry.name not in SKIPPED:
                    todo.append(entry.path)
            elif not entry.is_dir() and not is_excluded(os.path.relpath(entry.path, base).replace(os.sep, "/"), exclude):
                found.append((entry.path, False))
    many = spark.sparkContext.defaultParallelism * 4
    listed = spark.createDataFrame(found + [(d, True) for d in todo], "file string, deep boolean").repartition(max(1, min(len(found) + len(todo), many)))
    if todo:  # as many files as there may be below
        listed = listed.mapInPandas(lambda it: _walk(it, exclude, base), "file string").repartition(many)
    return listed.select("file").mapInPandas(_read, FILES)


def scan_binary(spark: SparkSession, root: str, globs: str = "*") -> DataFrame:
    """The same through Spark's own reader, for stores that only Hadoop paths reach."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", globs).load(root)
    return raw.select(F.col("path").alias("file"), "content", F.make_valid_utf8(F.col("content").cast("string")).alias("source"), T.language_of(F.col("path"), LANGUAGE_NAMES).alias("language"), F.lit(None).cast("string").alias("error"))


def from_table(df: DataFrame, file: Column, source: Column, language: Column | None = None) -> DataFrame:
    """Any table of ids and texts as files(file, source, language)."""
    lang = T.language_of(file, LANGUAGE_NAMES) if language is None else language
    return df.select(file.alias("file"), source.cast("string").alias("source"), lang.alias("language"))


PHP = "struct<variables:array<struct<name:string,n:int>>,assigns:array<struct<name:string,line:int>>,exempt:array<string>,dynamic:boolean,native_return:boolean,doc_return:string,start_line:int,insert_at:int>"
#: What parsing gives, as flat rows: one ``file`` row per file, its ``node`` rows, and ``php`` rows for PHP functions.
PARSED = f"row string, language string, error string, {NODE}, php {PHP}"


@dataclass(frozen=True)
class Provider:
    """A language of one's own: its name, extensions, a function from text to the root node (it raises
    trees.ParseError), and what tells one version of the tool behind it from another."""

    name: str
    extensions: tuple[str, ...]
    parse: Callable[[str], trees.Node]
    fingerprint: str = ""


def parse_one(file: str, source: str, language: str | None, providers: tuple[Provider, ...] = (), want: frozenset[str] = frozenset(("node", "php"))) -> tuple[str | None, list[tuple], list[tuple]]:
    """(error, node rows, (function's node, facts) of PHP) of one file."""
    own = next((p for p in providers if p.name == language), None)
    la = next((x for x in trees.LANGUAGES if x.name == language), None) if language else trees.language_for(file)
    if la is None and own is None:
        return None, [], []
    try:
        root, reader = (own.parse(source), None) if own else trees.parse(source, la, bool(want), file.endswith((".jsx", ".tsx")))
    except trees.ParseError as e:
        return str(e), [], []
    except RecursionError:
        return "nested too deeply", [], []
    if not want:
        return None, [], []
    data = source.encode("utf-8", "surrogatepass")
    all_nodes = list(root.walk())
    number = {id(n): k for k, n in enumerate(all_nodes)}
    parents = [-1] * len(all_nodes)
    for n in all_nodes:
        for c in n.children:
            parents[number[id(c)]] = number[id(n)]
    asked = ("If", "For", "Foreach", "While", "Do", "CatchClause", "FunctionDecl")
    # only a construct with an empty block below it is looked up in the text
    empty = [trees.genuinely_empty(data, n.line) if n.type in asked and any(c.type == "Block" and not c.children for c in n.children) else None for n in all_nodes]
    nodes = list(expand(file, parents, [n.type for n in all_nodes], [n.line for n in all_nodes], [n.attributes.get("name") for n in all_nodes], [n.attributes.get("kind") for n in all_nodes], empty)) if "node" in want else []
    php = [(number[id(n)], f) for n in all_nodes if n.type == "FunctionDecl" and reader is not None and (f := trees.php_facts(reader, n))] if "php" in want else []
    return None, nodes, php


@lru_cache(maxsize=1)
def _parsed_schema() -> pa.Schema:
    pair = lambda kind, name: pa.list_(pa.struct([("name", pa.string()), (name, kind)]))
    php = pa.struct([("variables", pair(pa.int32(), "n")), ("assigns", pair(pa.int32(), "line")), ("exempt", pa.list_(pa.string())), ("dynamic", pa.bool_()), ("native_return", pa.bool_()), ("doc_return", pa.string()), ("start_line", pa.int32()), ("insert_at", pa.int32())])
    return pa.schema([("row", pa.string()), ("language", pa.string()), ("error", pa.string()), *arrow_schema(), ("php", php)])


def _parse(batches: Iterator[pa.RecordBatch], providers: tuple[Provider, ...], want: frozenset[str]) -> Iterator[pa.RecordBatch]:
    blank = (None,) * (len(NODE_COLUMNS) - 2)
    schema = _parsed_schema()
    for batch in batches:
        for k in range(0, batch.num_rows, 64):  # a few files at a time, so that no batch of nodes grows large
            rows: list[tuple] = []
            for file, source, language in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns)):
                error, nodes, php = parse_one(file, source, language, providers, want) if source is not None else (None, [], [])
                rows.append(("file", language, error, file, None, *blank, None))
                rows += [("node", None, None, *n, None) for n in nodes]
                rows += [("php", None, None, file, i, *blank, f) for i, f in php]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def parse_files(files: DataFrame, providers: tuple[Provider, ...] = (), want: Iterable[str] = ("node", "php")) -> DataFrame:
    """Rows of PARSED for every file of a known language. ``want`` leaves out what isn't needed."""
    need = frozenset(want)
    return files.filter("language is not null and file is not null").select("file", "source", "language").mapInArrow(lambda it: _parse(it, providers, need), PARSED)


def node_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter("row = 'node'").select(*NODE_COLUMNS)


def php_rows(parsed: DataFrame) -> DataFrame:
    """(id, func_node_id, facts) of PHP functions."""
    return parsed.filter("row = 'php'").select("id", F.col("node_id").alias("func_node_id"), F.col("php").alias("facts"))


def file_rows(parsed: DataFrame) -> DataFrame:
    """(file, language, error)."""
    return parsed.filter("row = 'file'").select(F.col("id").alias("file"), "language", "error")


def parse_errors(parsed: DataFrame) -> DataFrame:
    return file_rows(parsed).filter("error is not null").select("file", F.lit(1).alias("line"), F.lit("parse-error").alias("rule"), F.lit("error").alias("severity"), F.col("error").alias("message"), F.lit(0).alias("k1"), F.lit(0).alias("k2"))


def unreadable(files: DataFrame) -> DataFrame:
    return files.filter("error is not null").select("file", F.lit(1).alias("line"), F.lit("unreadable-file").alias("rule"), F.lit("error").alias("severity"), F.col("error").alias("message"), F.lit(0).alias("k1"), F.lit(0).alias("k2"))
