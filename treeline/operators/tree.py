"""Rules and metrics over node rows.

Each row knows how deep it stands and what its rules ask of its parent (see ``schemas.NODE``),
so every structural rule is a filter. Only metrics group (by function) and no rule joins nodes
to nodes. The numbers are kept along the pre-order walk, so a row's size doesn't grow with depth.

Defined results: a null name counts as '?'; a node without a parent never is a body; unknown types count
as nothing; an empty table gives empty results; rows of one tree must have distinct node numbers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.schemas import NODE

# Which types nest, branch, and may have empty bodies.
CONTROL = ("If", "For", "Foreach", "While", "Do", "TryCatch")
BRANCH = ("If", "For", "Foreach", "While", "Do", "CatchClause")
LOOPS_AND_IF = ("If", "For", "Foreach", "While", "Do")
# Fixed value: names of functions that may well be empty.
MAY_BE_EMPTY = ("{closure}", "constructor", "__construct", "__init__")


def expand(ident: str, parents: list[int], types: list[str], lines: list[int], names: list, kinds: list, empty: list | None = None) -> Iterator[tuple]:
    """Node rows of one tree given in pre-order."""
    n = len(parents)
    kids = [0] * n
    order, later, first, has_block = [0] * n, [-1] * n, [False] * n, [False] * n
    last: dict[int, int] = {}
    for k in range(1, n):
        p = parents[k]
        order[k] = kids[p]
        kids[p] += 1
        if p in last:
            later[last[p]] = k
        last[p] = k
        if types[k] == "Block" and not has_block[p]:
            first[k] = has_block[p] = True
    depth, nest, owner, else_if = [0] * n, [0] * n, [-1] * n, [False] * n
    for k in range(n):
        p = parents[k]
        if p < 0:
            depth[k] = types[k] in CONTROL
            yield (ident, k, p, 0, types[k], lines[k], names[k], kinds[k], kids[k], int(depth[k]), 0, False, -1, None, None, None, None, False, None)
            continue
        t, pt = types[k], types[p]
        else_if[k] = t == "If" and pt == "If"
        depth[k] = depth[p] + (t in CONTROL and not else_if[k])
        owner[k], nest[k] = (p, 0) if pt == "FunctionDecl" else (owner[p], nest[p] + (pt in BRANCH and not else_if[p]))
        yield (
            ident, k, p, order[k], t, lines[k], names[k], kinds[k], kids[k], int(depth[k]), int(nest[k]), else_if[k], owner[k],
            pt, lines[p], names[p], True if empty is None else empty[p], first[k], lines[later[k]] if later[k] >= 0 else None,
        )


NODE_COLUMNS = [c.strip().split(" ")[0] for c in NODE.split(",")]


def _from_flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def text(v: str | None) -> str | None:
        return x if v and isinstance(x := json.loads(v), str) else None

    for batch in batches:
        rows: list[tuple] = []
        for ident, parents, types, lines, attributes in zip(*(c.to_pylist() for c in batch.columns)):
            own = [json.loads(a) if a else {} for a in attributes]
            rows += expand(str(ident), parents, types, [max(-(1 << 31), min((1 << 31) - 1, x)) for x in lines], [text(o.get("name")) for o in own], [text(o.get("kind")) for o in own])
        yield arrow_rows(rows)


@lru_cache(maxsize=1)
def arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in NODE.split(","))])


def arrow_rows(rows: list[tuple]) -> pa.RecordBatch:
    schema = arrow_schema()
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def nodes_of_trees(trees: DataFrame) -> DataFrame:
    """Node rows of flattened trees (see ``operators.nested``)."""
    return trees.select("id", "parents", "types", "lines", "attributes").mapInArrow(_from_flat, NODE)


# metrics


def function_metrics(nodes: DataFrame) -> DataFrame:
    """(id, node_id, name, line, cyclomatic, cognitive, statements): one row per function.

    One pass: a function counts for itself, a branch for the function that owns it, a body for its parent;
    no node is two of these."""
    own = F.col("type") == "FunctionDecl"
    branch = F.col("type").isin(*BRANCH) & (F.col("owner") >= 0)
    body = F.col("first_block") & (F.col("parent_type") == "FunctionDecl")
    key = F.when(own, F.col("node_id")).when(branch, F.col("owner")).when(body, F.col("parent_id"))
    part = nodes.filter(own | branch | body).select(
        "id", key.alias("node_id"), F.when(own, F.coalesce("name", F.lit("?"))).alias("name"), F.when(own, F.col("line")).alias("line"),
        branch.cast("int").alias("branches"), F.when(branch, F.when(F.col("else_if"), 1).otherwise(1 + F.col("nest"))).otherwise(0).alias("cost"), F.when(body, F.col("n_children")).otherwise(0).alias("statements"),
    )
    return part.groupBy("id", "node_id").agg(F.max("name").alias("name"), F.max("line").alias("line"), (1 + F.sum("branches")).cast("int").alias("cyclomatic"), F.sum("cost").cast("int").alias("cognitive"), F.sum("statements").cast("int").alias("statements"))


# rules: (file, line, rule, severity, message, k1, k2)


def _finding(df: DataFrame, line: Column, rule: str, message: Column, k1: Column, k2: Column | None = None, severity: str = "warning", extra: list[str] | None = None) -> DataFrame:
    return df.select(F.col("id").alias("file"), line.alias("line"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"), k1.cast("int").alias("k1"), (F.lit(0) if k2 is None else k2).cast("int").alias("k2"), *(extra or []))


def dead_code_after_return(nodes: DataFrame) -> DataFrame:
    """The statement after the first return of each block."""
    returns = nodes.filter("type = 'Return' and parent_type = 'Block'")
    first = returns.groupBy("id", "parent_id").agg(F.min_by("next_line", "ord").alias("next_line"))
    return _finding(first.filter("next_line is not null"), F.col("next_line"), "dead-code-after-return", F.lit("Code after a return never runs."), F.col("parent_id"))


def deep_nesting(nodes: DataFrame, max_depth: int = 4) -> DataFrame:
    deep = nodes.filter(F.col("type").isin(*CONTROL) & (F.col("depth") > max_depth))
    return _finding(deep, F.col("line"), "deep-nesting", F.concat(F.lit("Control structures nest "), F.col("depth"), F.lit(f" levels deep (more than {max_depth}).")), F.col("node_id"))


def empty_block(nodes: DataFrame) -> DataFrame:
    """Every empty block directly below a branch or loop."""
    rank = F.coalesce(*[F.when(F.col("parent_type") == t, F.lit(k)) for k, t in enumerate(LOOPS_AND_IF)])
    e = nodes.filter(F.col("parent_type").isin(*LOOPS_AND_IF) & (F.col("type") == "Block") & (F.col("n_children") == 0) & F.col("parent_empty"))
    return _finding(e, F.col("parent_line"), "empty-block", F.concat(F.lit("Empty body of "), F.col("parent_type"), F.lit(".")), rank * 10_000_000 + F.col("parent_id"), F.col("ord"))


def empty_catch(nodes: DataFrame) -> DataFrame:
    e = nodes.filter("parent_type = 'CatchClause' and ord = 0 and n_children = 0 and parent_empty")
    return _finding(e, F.col("parent_line"), "empty-catch", F.lit("The error is caught and ignored."), F.col("parent_id"))


def empty_function(nodes: DataFrame) -> DataFrame:
    name = F.coalesce("parent_name", F.lit("?"))
    e = nodes.filter("parent_type = 'FunctionDecl' and first_block and n_children = 0 and parent_empty").filter(~name.isin(*MAY_BE_EMPTY))
    return _finding(e, F.col("parent_line"), "empty-function", F.concat(F.lit("Function "), name, F.lit(" has no body.")), F.col("parent_id"))


def long_function(nodes: DataFrame, max_statements: int = 30) -> DataFrame:
    name = F.coalesce("parent_name", F.lit("?"))
    e = nodes.filter("parent_type = 'FunctionDecl' and first_block").filter(F.col("n_children") > max_statements)
    return _finding(e, F.col("parent_line"), "long-function", F.concat(F.lit("Function "), name, F.lit(" has "), F.col("n_children"), F.lit(f" statements (more than {max_statements}).")), F.col("parent_id"))


def complex_function(metrics: DataFrame, max_cognitive: int = 15) -> DataFrame:
    e = metrics.filter(F.col("cognitive") > max_cognitive)
    return _finding(e, F.col("line"), "complex-function", F.concat(F.lit("Function "), F.col("name"), F.lit(" has a cognitive complexity of "), F.col("cognitive"), F.lit(f" (more than {max_cognitive}).")), F.col("node_id"))


# PHP rules over (id, func_node_id, facts struct)


def unused_variable(php: DataFrame) -> DataFrame:
    """Assigned variables that occur nowhere else in their function."""
    # Variables that PHP provides.
    provided = ("this", "GLOBALS", "_SERVER", "_GET", "_POST", "_FILES", "_COOKIE", "_SESSION", "_REQUEST", "_ENV")
    a = php.filter("not facts.dynamic").select("id", "func_node_id", "facts", F.posexplode("facts.assigns").alias("k", "a"))
    n = F.element_at(F.filter("facts.variables", lambda v: v["name"] == F.col("a.name")), 1)["n"]
    e = a.filter(~F.col("a.name").isin(*provided) & ~F.array_contains("facts.exempt", F.col("a.name"))).filter(n == 1)
    return _finding(e, F.col("a.line"), "unused-variable", F.concat(F.lit("Variable $"), F.col("a.name"), F.lit(" is assigned but never read.")), F.col("func_node_id"), F.col("k"))


# Fixed value: documented types that can be native ones.
TYPE = r"^\??[A-Za-z_\\][A-Za-z0-9_\\]*(\|\??[A-Za-z_\\][A-Za-z0-9_\\]*)*$"


def promotable_return_type(php: DataFrame) -> DataFrame:
    """Documented return types that could be native, with the insertion that makes them so."""
    f = F.col("facts")
    e = php.filter(~f["native_return"] & f["doc_return"].isNotNull() & (f["insert_at"] >= 0)).filter(f["doc_return"].rlike(TYPE))
    fix = F.struct(f["insert_at"].cast("int").alias("start_offset"), f["insert_at"].cast("int").alias("end_offset"), F.concat(F.lit(": "), f["doc_return"]).alias("replacement"))
    message = F.concat(F.lit("The documented return type "), f["doc_return"], F.lit(" can be declared."))
    kept = e.select("id", "func_node_id", "facts", fix.alias("fix"), message.alias("_message"))
    return _finding(kept, f["start_line"], "promotable-return-type", F.col("_message"), F.col("func_node_id"), severity="info", extra=["fix"])
