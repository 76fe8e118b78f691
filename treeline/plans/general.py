"""Queries of the general-purpose operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.cluster import cut, table
from treeline.operators import nested, snapshots


def _trees(spark: SparkSession, d: str, with_values: bool) -> DataFrame:
    return nested.flatten_trees(table(spark, d, "ast_dumps"), "dump_id", "ast_json", "dumped_at", with_values)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.parent_links(_trees(spark, d, False)).select(F.col("id").alias("dump_id"), "parent_id", "node_id")


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.node_table(_trees(spark, d, True)).withColumnRenamed("id", "dump_id")


def p4_attributes(spark: SparkSession, d: str) -> DataFrame:
    return nested.attribute_table(_trees(spark, d, True)).withColumnRenamed("id", "dump_id")


def p4_ifs_in_functions(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes of type If stand below each function that has any, found by interval containment."""
    nodes = cut(nested.node_table(_trees(spark, d, True)).filter(F.col("type").isin("If", "FunctionDecl")))
    pairs = nested.within(nested.type_table(nodes, "If"), nested.type_table(nodes, "FunctionDecl"))
    return pairs.groupBy(F.col("id").alias("dump_id"), F.col("outer_id").alias("function_id")).agg(F.count("*").alias("ifs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "baseline_snapshots")).select("repo", "snapshot_no", "file", "rule", "message", "change")


def p5_summary(spark: SparkSession, d: str) -> DataFrame:
    found = snapshots.snapshot_changes(table(spark, d, "baseline_snapshots"))
    return found.groupBy("repo", "snapshot_no").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "changed", "removed")])


QUERIES = {"p4_found": p4_found, "p4_nodes": p4_nodes, "p4_attributes": p4_attributes, "p4_ifs_in_functions": p4_ifs_in_functions, "p5_found": p5_found, "p5_summary": p5_summary}

_P5 = """
WITH r AS (SELECT repo, snapshot_no, delivered_at, entry_id, regexp_replace(replace(coalesce(file, ''), '\\', '/'), '^(\\./+)+', '') AS file,
                  coalesce(rule, '') AS rule, coalesce(message, '') AS message, coalesce("count", 1) AS n
           FROM baseline_snapshots WHERE repo IS NOT NULL AND snapshot_no IS NOT NULL AND delivered_at IS NOT NULL),
s AS (SELECT repo, snapshot_no, max(delivered_at) AS delivered_at FROM r GROUP BY ALL),
l AS (SELECT *, lag(snapshot_no) OVER (PARTITION BY repo ORDER BY snapshot_no) AS prev_no FROM s),
e AS (SELECT r.repo, r.snapshot_no, file, rule, message, entry_id, max(n) AS n FROM r JOIN s USING (repo, snapshot_no, delivered_at) GROUP BY ALL),
k AS (SELECT repo, snapshot_no, file, rule, message, sum(n) AS n FROM e GROUP BY ALL),
old AS (SELECT k.repo, l.snapshot_no, file, rule, message, n FROM k JOIN l ON k.repo = l.repo AND k.snapshot_no = l.prev_no),
new AS (SELECT k.* FROM k JOIN l USING (repo, snapshot_no) WHERE prev_no IS NOT NULL),
d AS (SELECT repo, snapshot_no, file, rule, message,
      CASE WHEN old.n IS NULL THEN 'added' WHEN new.n IS NULL THEN 'removed' ELSE 'changed' END AS change
      FROM old FULL JOIN new USING (repo, snapshot_no, file, rule, message) WHERE old.n IS DISTINCT FROM new.n)
"""

SQL = {
    "p5_found": _P5 + "SELECT * FROM d",
    "p5_summary": _P5 + """SELECT repo, snapshot_no, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'changed') AS changed,
      count(*) FILTER (change = 'removed') AS removed FROM d GROUP BY ALL""",
}
