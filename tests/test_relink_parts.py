"""Pairs of a frequent key are cut in parts."""

from pyspark.sql import functions as F

from reelsift.operators import catalog


def test_a_frequent_key_is_cut_and_loses_no_pair(spark):
    left = spark.range(120).select("id", F.when(F.col("id") < 100, "often").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"))
    left = left.union(spark.createDataFrame([(500, None)], "id long, k string"))
    right = spark.range(60).select(F.col("id").alias("n"), F.when(F.col("id") < 50, "often").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("o"))
    got = catalog.meeting(left, right, "k", "o", block=10)
    want = left.join(right, F.col("k") == F.col("o"))
    assert sorted((r.id, r.n) for r in got.collect()) == sorted((r.id, r.n) for r in want.collect())
    assert got.where("k = 'often'").groupBy("__part").count().agg(F.max("count")).first()[0] <= 25 * 50
