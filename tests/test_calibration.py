"""Isotonic pools, their lookup and exact quantiles against plain passes."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelsift.operators import evaluate


def pools_of(pairs):
    """Adjacent violators pooled from left to right, equal neighbours apart; equal scores are one point."""
    points = {}
    for s, y in pairs:
        n, t = points.get(s, (0, 0))
        points[s] = n + 1, t + y
    out = []
    for s in sorted(points):
        out.append([s, *points[s]])
        while len(out) > 1 and Fraction(out[-2][2], out[-2][1]) > Fraction(out[-1][2], out[-1][1]):
            last = out.pop()
            out[-1] = [last[0], out[-1][1] + last[1], out[-1][2] + last[2]]
    return [(s, round(t / n, 9), n) for s, n, t in out]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_pools_merge_alike_in_any_number_of_ranges(spark, parts):
    r = random.Random(parts)
    for n, distinct, steepness in ((400, 400, 0.3), (300, 25, 1.0)):
        pairs = [(s / distinct, int(r.random() < 0.5 + steepness * (s / distinct - 0.5))) for s in (r.randrange(distinct) for _ in range(n))]
        got = evaluate.calibrator(spark.createDataFrame(pairs, "score double, label int").repartition(4), parts, fan=3).collect()
        assert sorted((x.edge, round(x.value, 9), x.n) for x in got) == pools_of(pairs)


def test_equal_neighbours_are_pools_of_their_own(spark):
    rows = spark.createDataFrame([(i / 20, int(i >= 10)) for i in range(20)], "score double, label int")
    assert evaluate.calibrator(rows, 3).count() == 20
    advice = evaluate.strategy(rows).first()
    assert (advice.n, advice.pools, advice.merge_ratio) == (20, 20, 0.0)
    assert evaluate.calibrator(rows.limit(0)).count() == 0


def test_lookup_takes_the_first_edge_not_below(spark):
    steps = spark.createDataFrame([(0.2, 0.1, 1), (0.5, 0.4, 1), (0.5, 0.6, 1), (0.9, 0.8, 1)], "edge double, value double, n long")
    scores = [None, -1.0, 0.2, 0.2000001, 0.5, 0.7, 0.9, 0.95, 0.2, 0.2]
    got = evaluate.calibrated(spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "id long, score double").repartition(3), steps)
    assert {r.id: r.probability for r in got.collect()} == dict(enumerate([None, 0.1, 0.1, 0.4, 0.4, 0.8, 0.8, 0.8, 0.1, 0.1]))
    assert got.columns == ["id", "score", "probability"]


def test_exact_quartiles_without_a_map_of_values(spark):
    r = random.Random(2)
    groups = {"a": [r.gauss(0, 1) for _ in range(2001)], "b": [5.0] * 40, "c": [1.0], "d": [1e-300, 1e300, -1e300, 0.0], "e": [float(r.randint(0, 3)) for _ in range(500)], None: [2.0, 3.0]}
    rows = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "k string, score double").repartition(5)
    plan = rows.groupBy("k").agg(F.count("*"))
    out = evaluate.describe(rows, ["k"])
    assert "percentile" not in out._jdf.queryExecution().toString() and plan
    for x in out.collect():
        v = np.array(groups[x.k])
        assert x.n == len(v)
        assert np.allclose([x.least, x.greatest, x.p25, x.median, x.p75], np.round([v.min(), v.max(), *np.percentile(v, [25, 50, 75])], 6), atol=1.1e-6, rtol=1e-12)
