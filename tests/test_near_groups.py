"""Groups of near rows, repeated videos and bounded states, against plain versions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelsift.operators import library, review
from reelsift.streaming import jobs
from tests.test_operators import rocksdb  # noqa: F401


def plain_keepers(rows, threshold):
    want, kept = {}, {}
    for i, g, s, v in sorted(rows, key=lambda x: (x[2] is None, -(x[2] or 0.0), x[0])):
        want[i] = i
        if not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        u = np.asarray(v) / (np.linalg.norm(v) or 1.0)
        near = next((k for k, w in kept.setdefault((g, len(v)), []) if u @ w >= threshold), None)
        if near is None:
            kept[g, len(v)].append((i, u))
        want[i] = i if near is None else near
    return want


@pytest.mark.parametrize("batches", [0, 1])
def test_near_keepers_by_cells(spark, monkeypatch, batches):
    r = np.random.default_rng(5)
    for name, n in (("BLOCK", 20), ("PIVOTS", 7), ("BATCHES", batches)):
        monkeypatch.setattr(review, name, n)
    base = r.standard_normal((15, 6))
    rows = [(i, None if i % 4 else 1, None if i % 17 == 0 else float(r.integers(0, 30)), list(map(float, base[i % 15] + r.standard_normal(6) * 0.3))) for i in range(300)]
    odd = [None, [], [0.0] * 6, [None, 1.0], [float("nan")] * 6, [float("inf")] * 6, [1.0, 2.0], [2.0, 4.0]]
    rows += [(400 + i, None, 5.0, v) for i, v in enumerate(odd)]
    got = review.near_keepers(spark.createDataFrame(rows, "id long, grp long, score double, vector array<double>"), 0.8, batch=8)
    want = plain_keepers(rows, 0.8)
    assert {x.id: x.keeper for x in got.collect()} == want and sum(i != k for i, k in want.items()) > 100
    assert review.near_keepers(got.sparkSession.createDataFrame([], "id long, grp long, score double, vector array<double>"), 0.8).isEmpty()


def test_near_keepers_rounds_do_not_grow_with_the_group(spark, monkeypatch):
    calls, plain = [], review._first_near
    monkeypatch.setattr(review, "_first_near", lambda *a: calls.append(1) or plain(*a))
    monkeypatch.setattr(review, "BATCHES", 1)
    r = np.random.default_rng(6)
    rows = [(i, 1, float(r.random()), list(map(float, v))) for i, v in enumerate(r.standard_normal((2000, 16)))]
    got = review.near_keepers(spark.createDataFrame(rows, "id long, grp long, score double, vector array<double>"), 0.7, batch=8)
    assert {x.id: x.keeper for x in got.collect()} == plain_keepers(rows, 0.7)
    assert len(calls) < 20


def test_fingerprint_duplicates_with_a_hash_that_most_share(spark):
    r = random.Random(7)
    flip = lambda h: h ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 5)))
    films = [[0 if r.random() < 0.7 else r.getrandbits(64), r.getrandbits(64), 0 if r.random() < 0.5 else r.getrandbits(64)] for _ in range(60)]
    rows = []
    for i in range(400):
        film = r.randrange(60)
        rows.append((i, (i * 7) % 400, film % 9 + r.random() * 3, [f"{flip(h):016x}" for h in films[film]]))
    rows += [(500, 500, 3.0, ["bad", *rows[0][3][1:]]), (501, 501, None, rows[0][3]), (502, 502, 1.0, rows[0][3][:2]), (503, 503, float("inf"), rows[0][3]), (504, 504, 1.0, None)]
    rows += [(600 + i, 600 + i, *rows[i][2:]) for i in range(20)]
    want = {}
    for v, p, d, h in rows[:400] + rows[405:]:
        near = [(q, w) for w, q, e, g in rows[:400] + rows[405:] if q < p and abs(d - e) <= 2 and all(bin(int(x, 16) ^ int(y, 16)).count("1") <= 5 for x, y in zip(h, g))]
        if near:
            want[v] = min(near)[1]
    got = library.fingerprint_duplicates(spark.createDataFrame(rows, "video long, position long, duration double, phashes array<string>"))
    assert {x.video: x.duplicate_of for x in got.collect()} == want and len(want) > 200


def test_bounded_ratings_restart_and_report_what_is_late(spark, tmp_path, rocksdb):  # noqa: F811
    at = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    shape = "event_id long, target_id long, rating string, created_at timestamp, undone_at timestamp, supersedes_event_id long"
    batches = [
        [(1, 1, "a", at(0), None, None), (2, 1, "b", at(10), None, None), (10, 2, "x", at(0), None, None), (11, 2, "y", at(5), None, 12)],
        # Target 1: a new span, so 2 is settled; target 2: 12 was superseded before it came.
        [(3, 1, "c", at(100), None, None), (12, 2, "z", at(6), None, None)],
        # 3 is undone in time, so 2 counts again; 1 is undone late, and 4 comes late.
        [(3, 1, "c", at(100), at(101), None), (1, 1, "a", at(0), at(101), None), (4, 1, "d", at(50), None, None)],
        # 5 supersedes what is settled: late, but counts itself.
        [(5, 1, "e", at(110), None, 2)],
        [(5, 1, "e", at(110), at(111), 2)],
    ]
    last, late = {}, []

    def take(batch, _):
        for x in batch.collect():
            late.append((x.target_id, x.event_id)) if x.late else last.update({x.target_id: (x.event_id, x.rating, x.created_at)})

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(spark.createDataFrame([], shape).schema).parquet(f"{tmp_path}/in")
        jobs.ratings_and_late(stream, keep=1800).writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        assert last[1] == [(2, "b", at(10)), (3, "c", at(100)), (2, "b", at(10)), (5, "e", at(110)), (2, "b", at(10))][n]
        assert last[2] == (11, "y", at(5))
    assert sorted(late) == [(1, 1), (1, 4), (1, 5), (1, 5)]
