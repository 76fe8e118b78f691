"""Changes between consecutive full snapshots of a keyed table.

Rows shrink to compact arrays first: a 128-bit key hash, the snapshot number and
the count. Those are spread by key hash (never by repo, which may hold a third
of all rows), sorted in numpy and compared by ``searchsorted``. Full values are
read again only for the keys that differ.

Defined results: rows with null repo, snapshot_no or delivered_at belong to no
snapshot and are left out; a null count is 1; null file, rule or message compare
as the empty text; repeated rows of one entry_id are one entry (the largest count
holds should they differ), and so are rows of one key without an entry_id;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.cluster import HOT_SHARE, cut, join_small, sieved

#: Compact rows that one numpy bucket should hold.
BUCKET_ROWS = 200_000

DIFF_SCHEMA = "k1 long, k2 long, snapshot_no int, value_no int, change string, old_count long, new_count long"


def plain_path(path: Column) -> Column:
    """'/'-separated and without leading './'."""
    return F.regexp_replace(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), r"^(\./+)+", "")


def snapshot_list(rows: DataFrame) -> DataFrame:
    """(repo, snapshot_no, delivered_at of the last delivery and its rows n, prev_no, next_no)."""
    each = rows.groupBy("repo", "snapshot_no", "delivered_at").agg(F.count("*").alias("n"))
    last = each.groupBy("repo", "snapshot_no").agg(F.max(F.struct("delivered_at", "n")).alias("x")).select("repo", "snapshot_no", "x.*")
    w = Window.partitionBy("repo").orderBy("snapshot_no")
    return last.withColumn("prev_no", F.lag("snapshot_no").over(w)).withColumn("next_no", F.lead("snapshot_no").over(w))


def compare_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """All snapshots of the keys in one bucket, by sorting and searchsorted."""
    if not len(pdf):
        return pd.DataFrame(columns=[c.split()[0] for c in DIFF_SCHEMA.split(", ")])
    keys = np.empty(len(pdf), dtype=[("a", np.int64), ("b", np.int64)])
    keys["a"], keys["b"] = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
    ident = np.unique(keys, return_inverse=True)[1].astype(np.int64)
    at = pdf["snapshot_no"].to_numpy(np.int64)
    low = at.min() - 1
    span = max(int(at.max() - low), 1) + 2
    prev, nxt = pdf["prev_no"].to_numpy(np.float64), pdf["next_no"].to_numpy(np.float64)
    count = pdf["n"].to_numpy(np.int64)
    code = ident * span + (at - low)
    order = np.argsort(code, kind="stable")
    code_sorted, count_sorted = code[order], count[order]

    def look(other: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the key stands in the other snapshot, and its count there."""
        wanted = ident * span + np.where(has & (other - low >= 0) & (other - low < span), other - low, span - 1).astype(np.int64)
        i = np.minimum(np.searchsorted(code_sorted, wanted), len(code_sorted) - 1)
        there = has & (code_sorted[i] == wanted)
        return there, count_sorted[i]

    has_prev, has_next = ~np.isnan(prev), ~np.isnan(nxt)
    in_prev, old = look(np.nan_to_num(prev), has_prev)
    in_next, _ = look(np.nan_to_num(nxt), has_next)
    parts = []
    for mask, change, when, before, after in (
        (has_prev & ~in_prev, "added", at, None, count),
        (has_prev & in_prev & (old != count), "changed", at, old, count),
        (has_next & ~in_next, "removed", np.nan_to_num(nxt).astype(np.int64), count, None),
    ):
        part = pdf.loc[mask, ["k1", "k2"]].copy()
        part["snapshot_no"] = when[mask]
        part["value_no"] = at[mask]
        part["change"] = change
        part["old_count"] = 0 if before is None else before[mask]
        part["new_count"] = 0 if after is None else after[mask]
        parts.append(part)
    return pd.concat(parts, ignore_index=True)


def snapshot_changes(snapshots: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(repo, snapshot_no, file, rule, message, change, old_count, new_count) of every
    entry that was added, removed or given another count against the repo's previous
    delivered snapshot."""
    rows = snapshots.select(
        "repo", F.col("snapshot_no").cast("int").alias("snapshot_no"), "delivered_at", "entry_id",
        plain_path(F.col("file")).alias("file"), F.coalesce("rule", F.lit("")).alias("rule"), F.coalesce("message", F.lit("")).alias("message"),
        F.coalesce(F.col("count").cast("long"), F.lit(1)).alias("n"),
    ).filter("repo is not null and snapshot_no is not null and delivered_at is not null")
    # the repo is part of the key, so compact rows need no text at all
    rows = rows.withColumn("k1", F.xxhash64("repo", "file", "rule", "message")).withColumn("k2", F.xxhash64(F.concat_ws("\u0001", "message", "rule", "file", "repo"), F.lit("second")))
    listed = cut(snapshot_list(rows))
    most = listed.agg((F.coalesce(F.sum("n"), F.lit(0)) / HOT_SHARE).alias("x")).first().x
    delivery = ["repo", "snapshot_no", "delivered_at"]
    compact = join_small(rows.select(*delivery, "entry_id", "k1", "k2", "n"), listed.drop("n"), delivery, hot=listed.filter(F.col("n") > most).select(*delivery))
    entry = compact.groupBy("snapshot_no", "prev_no", "next_no", "k1", "k2", "entry_id").agg(F.max("n").alias("n"))
    summed = entry.groupBy("snapshot_no", "prev_no", "next_no", "k1", "k2").agg(F.sum("n").alias("n"))
    buckets = max(1, -(-snapshots.count() // bucket_rows))
    differing = cut(
        summed.withColumn("_bucket", F.pmod("k1", F.lit(buckets)))
        .groupBy("_bucket")
        .applyInPandas(lambda pdf: compare_bucket(pdf.drop(columns="_bucket")), DIFF_SCHEMA)
    )
    values = rows.select("repo", F.col("snapshot_no").alias("value_no"), "k1", "k2", "file", "rule", "message")
    # what surely isn't wanted goes before texts are shuffled
    some = sieved(values, differing, ["k1", "value_no"])
    # each key once a snapshot, so that none is hot, and in the same shuffle as the join
    full = join_small(some.dropDuplicates(["value_no", "k1", "k2"]), differing, ["value_no", "k1", "k2"], even=True)
    return full.select("repo", "snapshot_no", "file", "rule", "message", "change", "old_count", "new_count")
