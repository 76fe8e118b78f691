"""Queries of the tree operators: over the JSON dumps (with SQL) and over parsed source files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.cluster import kept, table
from treeline.operators import nested, tree
from treeline.plans.code import RESULTS, results, source
from treeline.sources import files as S

Q = DataFrame
#: Depth, statements and complexity from which the dumps' small trees have findings.
MAX_DEPTH, MAX_STATEMENTS, MAX_COGNITIVE = 2, 3, 2


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return tree.nodes_of_trees(nested.flatten_trees(table(spark, d, "ast_dumps"), "dump_id", "ast_json", "dumped_at"))


def ast_flatten(spark: SparkSession, d: str) -> Q:
    n = nodes(spark, d)
    return n.select(F.col("id").cast("long").alias("dump_id"), "node_id", "parent_id", "ord", "type", "line", "name", "kind", "n_children")


def function_metrics(spark: SparkSession, d: str) -> Q:
    return tree.function_metrics(nodes(spark, d)).select(F.col("id").cast("long").alias("dump_id"), "node_id", "name", "line", "statements")


def cyclomatic(spark: SparkSession, d: str) -> Q:
    return tree.function_metrics(nodes(spark, d)).select(F.col("id").cast("long").alias("dump_id"), "node_id", "cyclomatic")


def cognitive(spark: SparkSession, d: str) -> Q:
    return tree.function_metrics(nodes(spark, d)).select(F.col("id").cast("long").alias("dump_id"), "node_id", "cognitive")


def _found(df: DataFrame) -> DataFrame:
    return df.select(F.col("file").cast("long").alias("dump_id"), "line", "rule", F.col("k1").alias("k1"), F.col("k2").alias("k2"), "message")


def dead_code_after_return(spark: SparkSession, d: str) -> Q:
    return _found(tree.dead_code_after_return(nodes(spark, d)))


def deep_nesting(spark: SparkSession, d: str) -> Q:
    return _found(tree.deep_nesting(nodes(spark, d), MAX_DEPTH))


def empty_block(spark: SparkSession, d: str) -> Q:
    return _found(tree.empty_block(nodes(spark, d)))


def empty_catch(spark: SparkSession, d: str) -> Q:
    return _found(tree.empty_catch(nodes(spark, d)))


def empty_function(spark: SparkSession, d: str) -> Q:
    return _found(tree.empty_function(nodes(spark, d)))


def long_function(spark: SparkSession, d: str) -> Q:
    return _found(tree.long_function(nodes(spark, d), MAX_STATEMENTS))


def complex_function(spark: SparkSession, d: str) -> Q:
    return _found(tree.complex_function(tree.function_metrics(nodes(spark, d)), MAX_COGNITIVE))


# parsed source files ----------------------------------------------------------------------


def parse_error(spark: SparkSession, d: str) -> Q:
    return S.parse_errors(S.parse_files(source(spark, d), want=())).select("file", "line", "message")


def source_metrics(spark: SparkSession, d: str) -> Q:
    """Metrics of every function of every source file."""
    n = S.node_rows(S.parse_files(source(spark, d), want=("node",)))
    return tree.function_metrics(n)


#: The results table lists higher values as this one.
LISTED_MOST = 41


def listed_functions(spark: SparkSession, d: str) -> Q:
    """The complexity, as parsed, of every function that the latest results list below their cap: in eight languages."""
    listed = results(spark, d).select(F.col("file").alias("id"), F.explode("functions").alias("f")).filter(F.col("f.cyclomatic") < LISTED_MOST).select("id", "f.name", "f.line").distinct()
    # every file once on the parsed side, a file's functions once on the other
    return source_metrics(spark, d).join(listed, ["id", "name", "line"]).select(F.col("id").alias("file"), "name", "line", "cyclomatic")


def structure_defaults(spark: SparkSession, d: str) -> Q:
    """The rules with options at their defaults over the dumps."""
    n = kept(nodes(spark, d))
    return _found(tree.deep_nesting(n)).unionByName(_found(tree.long_function(n))).unionByName(_found(tree.complex_function(tree.function_metrics(n))))


def source_structure(spark: SparkSession, d: str) -> Q:
    """Structural findings per rule over all source files, from one parse."""
    n = kept(S.node_rows(S.parse_files(source(spark, d), want=("node",))))
    rules = (tree.dead_code_after_return(n), tree.deep_nesting(n), tree.empty_block(n), tree.empty_catch(n), tree.empty_function(n), tree.long_function(n), tree.complex_function(tree.function_metrics(n), 5))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out.select("file", "line", "rule", "message")


def genuinely_empty(spark: SparkSession, d: str) -> Q:
    """Blocks without statements, and whether their braces hold nothing in the text either.

    The tables have no empty bodies, so every simple catch body is emptied or left with a comment."""
    bare = F.when(F.pmod(F.length("source"), F.lit(2)) == 0, "$1{ }").otherwise("$1{ /* nothing to do */ }")
    emptied = source(spark, d).withColumn("source", F.regexp_replace("source", F.lit(r"(catch \([^)]*\) )\{[^{}]*\}"), bare))
    n = S.node_rows(S.parse_files(emptied, want=("node",))).filter("type = 'Block' and n_children = 0 and parent_empty is not null")
    return n.select(F.col("id").alias("file"), "node_id", "parent_type", "parent_line", F.col("parent_empty").alias("empty"))


def unused_variable(spark: SparkSession, d: str) -> Q:
    return tree.unused_variable(S.php_rows(S.parse_files(source(spark, d).filter("language = 'PHP'"), want=("php",)))).select("file", "line", "message", "k1", "k2")


def promotable_return_type(spark: SparkSession, d: str) -> Q:
    """Source files whose doc comments all document a return type."""
    s = source(spark, d).filter("language = 'PHP'").withColumn("source", F.regexp_replace("source", r"\n \*/\nfunction", "\n * @return int|null\n */\nfunction"))
    return tree.promotable_return_type(S.php_rows(S.parse_files(s, want=("php",)))).select("file", "line", "message", "fix")


def scan_files(spark: SparkSession, d: str) -> Q:
    """This package's own files, scanned from disk."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    return S.scan_files(spark, root, ["__pycache__", "llm"]).select(F.substring("file", len(root) + 2, 1 << 30).alias("file"), "language", F.length("content").alias("bytes"))


def unreadable_file(spark: SparkSession, d: str) -> Q:
    """A listed file that can't be read becomes a finding."""
    listed = spark.createDataFrame([(f"{d}/no-such-file.php",)], "file string")
    return S.unreadable(listed.mapInPandas(S._read, S.FILES)).select("line", "rule", "severity")


_ALL = (
    ast_flatten, function_metrics, cyclomatic, cognitive, dead_code_after_return, deep_nesting, empty_block, empty_catch, empty_function, long_function, complex_function,
    structure_defaults, parse_error, source_metrics, listed_functions, source_structure, genuinely_empty, unused_variable, promotable_return_type, scan_files, unreadable_file,
)
QUERIES = {f.__name__: f for f in _ALL}

_CONTROL = "('If', 'For', 'Foreach', 'While', 'Do', 'TryCatch')"
_BRANCH = "('If', 'For', 'Foreach', 'While', 'Do', 'CatchClause')"
_OBJ = "json_type(j, '$.attributes') = 'OBJECT'"


def _text(name: str) -> str:
    return f"CASE WHEN {_OBJ} AND json_type(j, '$.attributes.{name}') = 'VARCHAR' THEN j->>'$.attributes.{name}' END"


NODES = f"""
WITH RECURSIVE src AS (SELECT row_number() OVER () AS rid, dump_id, dumped_at, ast_json AS j FROM ast_dumps WHERE dump_id IS NOT NULL AND json_valid(ast_json) AND json_type(ast_json) = 'OBJECT'),
t AS (SELECT rid, dump_id, dumped_at, j::JSON AS j, []::INT[] AS path, NULL::VARCHAR AS ptype, (j->>'$.type') AS type, false AS cont, ((j->>'$.type') IN {_CONTROL})::INT AS depth, 0 AS nest, NULL::INT[] AS fpath FROM src
  UNION ALL
  SELECT rid, dump_id, dumped_at, c.v, list_append(path, c.i), type, c.ty, c.ty = 'If' AND type = 'If', depth + (c.ty IN {_CONTROL} AND NOT (c.ty = 'If' AND type = 'If'))::INT,
    CASE WHEN type = 'FunctionDecl' THEN 0 ELSE nest + (type IN {_BRANCH} AND NOT cont)::INT END, CASE WHEN type = 'FunctionDecl' THEN path ELSE fpath END
  FROM (SELECT t.*, json_extract(j, '$.children') AS kids FROM t) t,
    LATERAL (SELECT v, i, v->>'$.type' AS ty FROM (SELECT unnest(json_extract(kids, '$[*]')) AS v, unnest(range(json_array_length(kids)::BIGINT))::INT AS i)) c
  WHERE json_type(kids) = 'ARRAY' AND json_type(c.v) = 'OBJECT'),
ok AS (SELECT rid, dump_id, dumped_at FROM t GROUP BY ALL HAVING bool_and(coalesce(json_type(j, '$.type') = 'VARCHAR' AND json_type(j, '$.line') IN ('BIGINT', 'UBIGINT'), false))),
one AS (SELECT arg_max(rid, (dumped_at, rid)) AS rid FROM ok GROUP BY dump_id),
m AS (SELECT t.*, (row_number() OVER (PARTITION BY rid ORDER BY path) - 1)::INT AS node_id, (j->>'$.line')::BIGINT AS line, {_text("name")} AS name, {_text("kind")} AS kind FROM t WHERE rid IN (SELECT rid FROM one)),
n AS (SELECT m.*, coalesce(p.node_id, -1) AS parent_id, p.line AS pline, p.name AS pname, f.node_id AS func_id,
      CASE WHEN p.rid IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY m.rid, p.node_id ORDER BY m.path) - 1 END AS ord,
      CASE WHEN p.rid IS NOT NULL THEN lead(m.line) OVER (PARTITION BY m.rid, p.node_id ORDER BY m.path) END AS next_line,
      m.type = 'Block' AND p.rid IS NOT NULL AND row_number() OVER (PARTITION BY m.rid, p.node_id, m.type ORDER BY m.path) = 1 AS first_block
      FROM m LEFT JOIN m p ON m.rid = p.rid AND len(m.path) > 0 AND p.path = m.path[:-2] LEFT JOIN m f ON m.rid = f.rid AND f.path = m.fpath),
k AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN (SELECT rid, parent_id AS node_id, count(*) AS n_children FROM n GROUP BY ALL) c USING (rid, node_id))"""
_METRICS = (
    NODES
    + f""",
b AS (SELECT rid, func_id AS node_id, count(*) AS n, sum(CASE WHEN cont THEN 1 ELSE 1 + nest END) AS cost FROM k WHERE type IN {_BRANCH} AND func_id IS NOT NULL GROUP BY ALL),
s AS (SELECT rid, parent_id AS node_id, n_children FROM k WHERE first_block AND ptype = 'FunctionDecl'),
g AS (SELECT k.dump_id, k.node_id, coalesce(k.name, '?') AS name, k.line, (1 + coalesce(n, 0))::INT AS cyclomatic, coalesce(cost, 0)::INT AS cognitive, coalesce(s.n_children, 0)::INT AS statements
      FROM k LEFT JOIN b USING (rid, node_id) LEFT JOIN s USING (rid, node_id) WHERE k.type = 'FunctionDecl')"""
)


def _deep(most: int) -> str:
    return f" SELECT dump_id, line, 'deep-nesting' AS rule, node_id AS k1, 0 AS k2, 'Control structures nest ' || depth || ' levels deep (more than {most}).' AS message FROM k WHERE type IN {_CONTROL} AND depth > {most}"


def _long(most: int) -> str:
    return f" SELECT dump_id, pline AS line, 'long-function' AS rule, parent_id AS k1, 0 AS k2, 'Function ' || coalesce(pname, '?') || ' has ' || n_children || ' statements (more than {most}).' AS message FROM k WHERE ptype = 'FunctionDecl' AND first_block AND n_children > {most}"


def _complex(most: int) -> str:
    return f" SELECT dump_id, line, 'complex-function' AS rule, node_id AS k1, 0 AS k2, 'Function ' || name || ' has a cognitive complexity of ' || cognitive || ' (more than {most}).' AS message FROM g WHERE cognitive > {most}"


SQL = {
    "ast_flatten": NODES + " SELECT dump_id, node_id, parent_id, ord, type, line, name, kind, n_children FROM k",
    "function_metrics": _METRICS + " SELECT dump_id, node_id, name, line, statements FROM g",
    "cyclomatic": _METRICS + " SELECT dump_id, node_id, cyclomatic FROM g",
    "cognitive": _METRICS + " SELECT dump_id, node_id, cognitive FROM g",
    "dead_code_after_return": NODES
    + " SELECT dump_id, line, 'dead-code-after-return' AS rule, parent_id AS k1, 0 AS k2, 'Code after a return never runs.' AS message FROM (SELECT dump_id, parent_id, arg_min(coalesce(next_line, -9), ord) AS line FROM k WHERE type = 'Return' AND ptype = 'Block' GROUP BY ALL) WHERE line <> -9",
    "deep_nesting": NODES + _deep(MAX_DEPTH),
    "empty_block": NODES
    + " SELECT dump_id, pline AS line, 'empty-block' AS rule, CASE ptype WHEN 'If' THEN 0 WHEN 'For' THEN 1 WHEN 'Foreach' THEN 2 WHEN 'While' THEN 3 ELSE 4 END * 10000000 + parent_id AS k1, ord AS k2, 'Empty body of ' || ptype || '.' AS message FROM k WHERE ptype IN ('If', 'For', 'Foreach', 'While', 'Do') AND type = 'Block' AND n_children = 0",
    "empty_catch": NODES + " SELECT dump_id, pline AS line, 'empty-catch' AS rule, parent_id AS k1, 0 AS k2, 'The error is caught and ignored.' AS message FROM k WHERE ptype = 'CatchClause' AND ord = 0 AND n_children = 0",
    "empty_function": NODES
    + " SELECT dump_id, pline AS line, 'empty-function' AS rule, parent_id AS k1, 0 AS k2, 'Function ' || coalesce(pname, '?') || ' has no body.' AS message FROM k WHERE ptype = 'FunctionDecl' AND first_block AND n_children = 0 AND coalesce(pname, '?') NOT IN ('{closure}', 'constructor', '__construct', '__init__')",
    "long_function": NODES + _long(MAX_STATEMENTS),
    "complex_function": _METRICS + _complex(MAX_COGNITIVE),
    "structure_defaults": _METRICS + _deep(4) + " UNION ALL" + _long(30) + " UNION ALL" + _complex(15),
    "listed_functions": f"WITH {RESULTS} SELECT DISTINCT file, f.name, f.line, f.cyclomatic FROM (SELECT file, unnest(functions) AS f FROM res) WHERE f.cyclomatic < {LISTED_MOST}",
}
# pre-order numbers of a subtree are consecutive, so the last one below a node and its post-order number follow from sizes and depths
_BELOW = (
    NODES
    + """,
z AS (SELECT a.rid, a.node_id, count(*) AS size, any_value(len(a.path)) AS above FROM m a JOIN m b ON a.rid = b.rid AND b.path[:len(a.path)] = a.path GROUP BY ALL)"""
)
P4 = {
    "p4_found": NODES + " SELECT dump_id, parent_id, node_id FROM k",
    "p4_nodes": _BELOW + " SELECT dump_id, node_id, parent_id, (node_id + size - 1)::INT AS last, (node_id + size - 1 - above)::INT AS post, type, line FROM k JOIN z USING (rid, node_id)",
    "p4_attributes": NODES + f" SELECT dump_id, node_id, name, json_extract(j, '$.attributes.\"' || name || '\"')::VARCHAR AS value FROM (SELECT dump_id, node_id, j, unnest(json_keys(j, '$.attributes')) AS name FROM m WHERE {_OBJ})",
    "p4_ifs_in_functions": NODES + " SELECT f.dump_id, f.node_id AS function_id, count(*) AS ifs FROM m f JOIN m i ON f.rid = i.rid AND len(i.path) > len(f.path) AND i.path[:len(f.path)] = f.path WHERE f.type = 'FunctionDecl' AND i.type = 'If' GROUP BY ALL",
}
