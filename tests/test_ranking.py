"""Skew-safe ranking equals a plain window, also when one key holds most rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from terminus.plans.ranking import cumulative_within, sequence_within, top_k_within


def test_sequence_with_hot_key(spark):
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 10 < 7, F.lit(0)).otherwise(F.col("id") % 5).alias("k"),
        (F.col("id") * 7919 % 3001).alias("o"), "id")
    got = sequence_within(df, ["k"], [F.col("o").asc(), F.col("id").asc()], "rn")
    ref = df.withColumn("rn2", F.row_number().over(Window.partitionBy("k").orderBy("o", "id")))
    j = got.join(ref, ["k", "o", "id"])
    assert j.count() == 3000 and j.filter("rn != rn2").count() == 0


def test_running_sum_and_global(spark):
    df = spark.range(0, 1000).select((F.col("id") % 3).alias("k"), "id", ((F.col("id") % 7) - 3).alias("v"))
    got = cumulative_within(df, ["k"], [F.col("id").asc()], "s", F.col("v"))
    ref = df.withColumn("s2", F.sum("v").over(Window.partitionBy("k").orderBy("id")))
    assert got.join(ref, ["k", "id", "v"]).filter("s != s2").count() == 0
    g = sequence_within(df, [], [F.col("id").desc()], "rn")
    assert g.filter(F.col("rn") != 1000 - F.col("id")).count() == 0


def test_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k long, o long")
    got = {(r.k, r.o): r.rn for r in sequence_within(df, ["k"], [F.col("o").asc()], "rn").collect()}
    assert got == {(None, 1): 1, (None, 2): 2, (1, 3): 1}


def test_top_k_plans_group_limit(spark):
    df = spark.range(0, 100).select((F.col("id") % 4).alias("k"), "id")
    top = top_k_within(df, ["k"], [F.col("id").desc()], 3, out="r")
    assert top.count() == 12
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
