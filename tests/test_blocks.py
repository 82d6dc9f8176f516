"""Blockwise running values equal plain windows, also when one key holds most rows."""

import random

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rosterflow.operators import blocks


def skewed(spark, n=600):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, rng.randrange(1000) if rng.random() < 0.8 else None)
            for i in rng.sample(range(5000), n)]
    return spark.createDataFrame(rows, "k string, seq bigint, v int")


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_running_max(spark):
    df = skewed(spark)
    for current, end in ((False, -1), (True, 0)):
        got = blocks.running_max(
            df, ["k"], ["seq"], F.col("v"), blocks.by_sequence("seq", 97), "m", include_current=current)
        want = df.withColumn("m", F.max("v").over(
            W.partitionBy("k").orderBy("seq").rowsBetween(W.unboundedPreceding, end)))
        assert same(got, want)


def test_running_count_both_directions(spark):
    df = skewed(spark)
    up = blocks.running_count(df, ["k"], [F.col("seq")], blocks.by_sequence("seq", 97), "r")
    assert same(up, df.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("seq")).cast("bigint")))
    down = blocks.running_count(
        df, ["k"], [F.col("seq").desc()], blocks.by_sequence("seq", 97), "r", descending=True)
    assert same(down, df.withColumn("r", F.row_number().over(
        W.partitionBy("k").orderBy(F.col("seq").desc())).cast("bigint")))


def test_running_count_without_keys(spark):
    df = skewed(spark)
    got = blocks.running_count(df, [], [F.col("seq")], blocks.by_sequence("seq", 97), "r")
    ranked = sorted(r.seq for r in df.collect())
    assert {r.seq: r.r for r in got.collect()} == {s: i + 1 for i, s in enumerate(ranked)}
