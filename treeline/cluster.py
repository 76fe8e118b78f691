"""What every operator needs from the cluster: cutting lineage, joins that
stay whole under skew, and a bound on whatever is broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which the small side of a join is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 20_000
#: A key with more than one in so many rows is joined apart; there are fewer such keys than this.
HOT_SHARE = 10_000
#: Different numbers in the sieve that keeps rows out of a shuffle.
SIEVE = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own, which goes with the process. On a cluster
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` lets Spark delete what no frame refers to any more."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if there:
        return there
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="treeline-checkpoint-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder; its lineage ends there."""
    spark = df.sparkSession
    there = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` persisted in memory and disk for a few reuses within one query."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def hot_keys(rows: DataFrame, keys: list[str], share: int = HOT_SHARE) -> DataFrame:
    """Keys that hold more than one in ``share`` of all rows: fewer than ``share`` of them, whatever the rows."""
    counts = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(known(keys)))
    most = counts.agg((F.coalesce(F.sum("_n"), F.lit(0)) / share).alias("x")).first().x
    return counts.filter(F.col("_n") > most).select(*keys)


def known(keys: list[str]) -> Column:
    """None of the keys is null."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def join_split(big: DataFrame, small: DataFrame, keys: list[str], how: str, hot: DataFrame) -> DataFrame:
    """A join of two large sides where ``hot`` (fewer than HOT_SHARE rows) names the keys that hold much of ``big``.

    Rows of hot keys stay where they are and meet a broadcast of those keys' rows of ``small``, of which there
    must be few a key; so do rows with a null key, which match nothing. All others are shuffled."""
    hot = F.broadcast(hot)
    apart = big.join(hot.withColumn("_hot", F.lit(True)), keys, "left").withColumn("_hot", F.coalesce("_hot", ~known(keys)))
    there = apart.filter("_hot").drop("_hot").join(F.broadcast(small.join(hot, keys, "left_semi")), keys, how)
    return there.unionByName(apart.filter("not _hot").drop("_hot").join(small, keys, how))


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", limit: int = BROADCAST_ROWS, hot: DataFrame | None = None, even: bool = False) -> DataFrame:
    """Join where ``small`` is expected to be small but need not be; it has few rows a key.

    Up to ``limit`` rows it is broadcast. Beyond that both sides are shuffled, apart from keys
    that hold much of ``big``: those named by ``hot``, or else found by counting ``big`` once.
    ``even``: no key can hold much, so nothing is counted. The result is the same.
    ``how`` is inner, left, left_semi or left_anti. ``small`` is read twice: cut it if it is costly."""
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), keys, how)
    if even:
        return big.join(small, keys, how)
    return join_split(big, small, keys, how, hot_keys(big, keys) if hot is None else hot)


def sieved(big: DataFrame, small: DataFrame, keys: list[str], size: int = SIEVE) -> DataFrame:
    """``big`` without rows whose keys surely aren't in ``small``, so that they aren't shuffled for a join.

    At most ``size`` small numbers are broadcast; with far more keys than that it keeps nothing out."""
    number = F.pmod(F.xxhash64(*keys), F.lit(size)).cast("int")
    wanted = small.select(number.alias("_s")).distinct()
    return big.withColumn("_s", number).join(F.broadcast(wanted), "_s", "left_semi").drop("_s")


def current(df: DataFrame, ident: str, order: str, content: list[str]) -> DataFrame:
    """``df`` without rows that a later copy with other ``content`` replaces; equal copies stay.

    Only digests are shuffled, and rows only where an id has copies that differ."""
    digest = df.withColumn("_d", F.xxhash64(*content))
    each = digest.groupBy(ident, "_d").agg(F.max(order).alias("_at"))
    best = each.groupBy(ident).agg(F.max(F.struct("_at", "_d")).alias("_b"), F.count("*").alias("_n")).filter("_n > 1")
    stale = cut(each.join(best, ident).filter("_d != _b._d").select(ident, "_d"))
    return join_small(digest, stale, [ident, "_d"], "left_anti", even=True).drop("_d")


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's number (from 1) within its keys by ``order``, however many rows a key has.

    Rows are sorted over the cluster by range, so a key may span many tasks; each task numbers its own
    rows, and only the sizes of its stretches are added up to know where the next begins."""
    ways = {f"_o{k}": c for k, c in enumerate(order)}
    by = [*keys, *ways]
    rows = cut(df.withColumns(ways).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()))
    sizes = rows.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # only stretches that something stands before: at most one a task
    moved = F.broadcast(sizes.withColumn("_before", before).filter("_before > 0").drop("_n"))
    own = rows.withColumn(name, F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*ways)))
    same = own["_part"] == moved["_part"]
    for k in keys:
        same = same & own[k].eqNullSafe(moved[k])
    return own.join(moved, same, "left").select(*[own[c] for c in df.columns], (own[name] + F.coalesce(moved["_before"], F.lit(0))).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
