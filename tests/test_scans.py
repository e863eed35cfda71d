"""Running values in two levels against windows over whole keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelsift.operators.scans import Segments


@pytest.mark.parametrize("parts", [1, 7])
def test_running_values_are_those_of_one_window(spark, parts):
    r = random.Random(3)
    rows = [(None if k == 9 else k, r.randint(0, 400), i, r.choice([None, r.randint(-9, 9)])) for i in range(3000) for k in [r.choice([1, 1, 1, 1, 2, 3, 4, 5, 9])]]
    df = spark.createDataFrame(rows, "k long, t long, id long, x long").repartition(5)
    w = Window.partitionBy("k").orderBy("t", "id")
    to, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "id", F.sum("x").over(to).alias("s"), F.row_number().over(w).cast("long").alias("n"), F.max("x").over(to).alias("m"), F.max("x").over(before).alias("mb"),
        F.last("x", True).over(to).alias("l"), F.last("x", True).over(before).alias("lb"), F.lag("x").over(w).alias("g"), F.sum("x").over(before).alias("sb"),
    )
    got = Segments(df, ["k"], ["t", "id"], parts).add(s=("sum", "x"), n=("count", "x"), m=("max", "x"), mb=("max_before", "x"), l=("last", "x"), lb=("last_before", "x"), g=("lag", "x"), sb=("sum_before", "x"))
    assert sorted(got.rows.select(*want.columns).collect(), key=lambda x: x.id) == sorted(want.collect(), key=lambda x: x.id)


def test_a_second_scan_goes_on_from_the_first_and_descends(spark):
    df = spark.createDataFrame([(1, i) for i in range(500)], "k long, t long")
    s = Segments(df, ["k"], [F.desc("t")], 6).add(p=("lag", "t")).map(gap=F.coalesce(F.col("p") - F.col("t"), F.lit(0))).add(total=("sum", "gap"))
    assert {r.t: r.total for r in s.rows.collect()} == {i: 499 - i for i in range(500)}


def test_a_key_with_half_of_all_rows_is_spread(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    s = Segments(df, ["k"], ["id"], 8)
    sizes = [r[0] for r in s._rows.groupBy("__part").agg(F.count("*")).select("count(1)").collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sorted(sizes)[4]
    assert s.add(n=("count", "id")).rows.agg(F.max("n")).first()[0] == 10_000


def test_empty(spark):
    assert Segments(spark.createDataFrame([], "k long, t long"), ["k"], ["t"]).add(s=("sum", "t")).rows.count() == 0
