import pytest
from pyspark.sql import functions as F

from treeline import cluster


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_small_is_the_same_beyond_its_limit(spark, how):
    big = spark.range(500).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id")).alias("v"), F.array("id").alias("a"))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (99, "d"), (None, "e")], "k long, w string")
    want = sorted(map(repr, big.join(small, "k", how).collect()))
    assert sorted(map(repr, cluster.join_small(big, small, ["k"], how).collect())) == want
    big = big.unionByName(spark.createDataFrame([(None, 7, [7])], big.schema))
    want = sorted(map(repr, big.join(small, "k", how).collect()))
    assert sorted(map(repr, cluster.join_small(big, small, ["k"], how, limit=2).collect())) == want
    assert sorted(map(repr, cluster.join_small(big, small, ["k"], how, limit=2, even=True).collect())) == want
    for hot in ([], [0], [0, 1, 5]):
        there = spark.createDataFrame([(x,) for x in hot], "k long")
        assert sorted(map(repr, cluster.join_small(big, small, ["k"], how, limit=2, hot=there).collect())) == want
    assert sorted(map(repr, cluster.join_small(big, small.limit(0), ["k"], how).collect())) == sorted(map(repr, big.join(small.limit(0), "k", how).collect()))


def test_cut_keeps_rows_and_ends_lineage(spark):
    df = cluster.cut(spark.range(10).repartition(3))
    assert df.count() == 10 and "Exchange" not in df._jdf.queryExecution().toString()
    assert cluster.shared_dir(spark) == spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)


def test_hot_keys_are_those_with_many_rows(spark):
    df = spark.createDataFrame([(1, "x")] * 60 + [(k, "y") for k in range(2, 42)] + [(None, None)] * 30, "k long, v string")
    assert [r.k for r in cluster.hot_keys(df, ["k"], share=10).collect()] == [1]
    assert cluster.hot_keys(df.limit(0), ["k"]).collect() == []


def test_ranked_numbers_rows_of_keys_that_span_tasks(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.randrange(40)) for k in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    got = cluster.ranked(df, ["k"], [F.col("v"), F.col("i")], "n").collect()
    want = {}
    for k in ("a", "b", None):
        for n, (_, i, _) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])), 1):
            want[i] = n
    assert {r.i: r.n for r in got} == want and len(got) == 400
    assert cluster.ranked(df.limit(0), ["k"], [F.col("v")], "n").collect() == []


def test_sieve_keeps_every_wanted_row(spark):
    big, small = spark.range(1000).select(F.col("id").alias("k")), spark.range(0, 1000, 50).select(F.col("id").alias("k"))
    for size in (1, 7, 1 << 20):
        got = cluster.sieved(big, small, ["k"], size)
        assert got.join(small, "k").count() == 20 and (size < 8 or got.count() < 40)


def test_current_copies(spark):
    rows = [(1, 1, "a"), (1, 3, "b"), (1, 2, "c"), (2, 1, "x"), (2, 2, "x"), (3, 1, "p"), (3, 1, "q")]
    df = spark.createDataFrame(rows, "id long, at int, t string")
    got = sorted(map(tuple, cluster.current(df, "id", "at", ["t"]).collect()))
    assert [r for r in got if r[0] < 3] == [(1, 3, "b"), (2, 1, "x"), (2, 2, "x")] and len([r for r in got if r[0] == 3]) == 1
    assert cluster.current(df.limit(0), "id", "at", ["t"]).collect() == []
