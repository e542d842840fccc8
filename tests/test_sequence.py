"""Bucketed LAG/LEAD and running sums equal the plain window versions."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from vantage.operators.sequence import day_bucket, running_sum, shift


def _data(spark, n=400, keys=3, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = 0 if rnd.random() < 0.6 else rnd.randrange(1, keys)  # one hot key
        day = rnd.randrange(0, 6)
        rows.append((k, f"2024-01-0{day + 1} {rnd.randrange(24):02d}:{rnd.randrange(60):02d}:00", i, rnd.choice([1, -1]), rnd.randrange(100)))
    df = spark.createDataFrame(rows, "k long, t string, id long, d int, v int")
    return df.withColumn("ts", F.to_timestamp_ntz("t")).drop("t")


def test_shift_matches_window(spark):
    df = _data(spark)
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = df.select("id", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"))
    lag = shift(df, ["k"], ["ts", "id"], ["v"], day_bucket("ts"), "lag").select("id", F.col("prev_v").alias("p"))
    lead = shift(df, ["k"], ["ts", "id"], ["v"], day_bucket("ts"), "lead").select("id", F.col("next_v").alias("n"))
    got = lag.join(lead, "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_running_sum_matches_window(spark):
    df = _data(spark)
    w = Window.partitionBy("k").orderBy("ts", "id")
    base = df.withColumn("s", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    want = base.select("id", "s", F.min("s").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"))
    got = running_sum(df, ["k"], ["ts", "id"], "d", day_bucket("ts"), out="s", min_before="m").select("id", "s", "m")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
