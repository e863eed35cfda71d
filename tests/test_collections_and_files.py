"""Maps and sets of many collections, files of any length, snapshots."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelsift.operators import explain, library, review
from reelsift.sources import files


def test_maps_of_collections_are_their_own_projections(spark):
    r = np.random.default_rng(4)
    groups = {k: r.normal(size=(r.integers(3, 40), 6)) @ np.diag([5, 3, 1, 1, 0.5, 0.1]) for k in range(20)}
    groups[20], groups[21] = np.ones((1, 6)), np.outer(np.arange(5.0), np.arange(6.0))  # one vector; rank one
    rows = [(k if k else None, 1000 * k + i, x.tolist()) for k, v in groups.items() for i, x in enumerate(v)] + [(3, -1, None)]
    got = {}
    for x in explain.taste_maps(spark.createDataFrame(rows, "c long, id long, vector array<double>").repartition(5), "c").collect():
        got.setdefault(x.c or 0, {})[x.id] = (x.x, x.y)
    for k, v in groups.items():
        centred = v - v.mean(0)
        value, axes = np.linalg.eigh(centred.T @ centred)
        want = centred @ axes[:, ::-1][:, :2]
        want[:, value[::-1][:2] < 1e-9] = 0
        want *= np.where(want[np.argmax(np.round(np.abs(want), 9), axis=0), [0, 1]] < 0, -1, 1)
        assert np.allclose([got[k][1000 * k + i] for i in range(len(v))], want, atol=1e-6), k


def test_sets_of_a_hundred_collections_are_those_of_plain_rounds(spark):
    r = random.Random(6)
    rows = [(c, 1000 * c + i, r.random(), None if r.random() < 0.1 else [r.gauss(0, 1) for _ in range(4)]) for c in range(100) for i in range(r.randint(1, 30))]
    got = {}
    for x in review.diverse_sets(spark.createDataFrame(rows, "c long, id long, score double, vector array<double>"), "c", 4, 0.4).collect():
        got.setdefault(x.c, []).append((x.rank, x.id))
    for c in range(100):
        left = {i: (s, None if v is None else np.array(v) / np.linalg.norm(v)) for k, i, s, v in rows if k == c}
        chosen = []
        while left and len(chosen) < 4:
            gap = lambda i: min((1 - float(left[i][1] @ u) if left[i][1] is not None and u is not None else 0.0 for _, u in chosen), default=0.0)  # noqa: B023, E731
            pick = max(left, key=lambda i: (round(0.6 * left[i][0] + 0.4 * gap(i) if chosen else left[i][0], 12), -i))  # noqa: B023
            chosen.append((pick, left.pop(pick)[1]))
        assert [i for _, i in sorted(got[c])] == [i for i, _ in chosen]


def test_a_file_of_over_two_gigabytes(spark, tmp_path):
    size, block = (1 << 31) + 5, 1 << 20
    with open(tmp_path / "a b#c.mkv", "wb") as f:
        f.write(b"head")
        f.truncate(size)
        f.seek(size - 3)
        f.write(b"end")
    (tmp_path / "small.png").write_bytes(b"x" * 10)
    zeros = bytes(1 << 24)
    digest, left = hashlib.sha256(b"head"), size - 7
    while left:
        digest.update(zeros[: min(left, 1 << 24)])
        left -= min(left, 1 << 24)
    digest.update(b"end")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.scan_media(spark, str(tmp_path), block).collect()}
    big = got["a b#c.mkv"]
    ends = hashlib.sha256(b"head" + bytes(block - 4) + bytes(block - 3) + b"end").hexdigest()
    assert (big.length, big.sha256, big.fingerprint) == (size, digest.hexdigest(), f"{size}::{ends}")
    assert got["small.png"].sha256 == hashlib.sha256(b"x" * 10).hexdigest() and got["small.png"].media_type == "image"


def test_rescoring_that_breaks_off_leaves_the_snapshot_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(1, "candidate", 0.5, 0.1, None, "v1", "x"), (2, "candidate", None, 0.2, None, "v1", "y"), (3, "liked", 0.5, 0.3, None, "v1", "z")], "id long, status string, base double, final_score double, profile_score double, profile_version string, other string")
    assert files.write_snapshot(rows, path) == 1
    with pytest.raises(Exception, match="stop"):
        files.write_snapshot(files.read_snapshot(spark, path).withColumn("base", F.raise_error(F.lit("stop")).cast("double")), path)
    assert files.read_snapshot(spark, path).count() == 3
    vectors = spark.createDataFrame([(1, "m", 4), (2, "m", 4), (3, "m", 4)], "id long, model string, dim int")
    new = spark.createDataFrame([(i, 0.9, 0.8) for i in (1, 2, 3)], "id long, final_score double, profile_score double")
    assert files.write_snapshot(library.rescored(files.read_snapshot(spark, path), vectors, new, "m", 4, "v2"), path) == 2
    got = {r.id: (r.final_score, r.profile_score, r.profile_version, r.other) for r in files.read_snapshot(spark, path).collect()}
    assert got == {1: (0.9, 0.8, "v2", "x"), 2: (0.2, None, "v1", "y"), 3: (0.3, None, "v1", "z")}
    assert library.rescored(rows, vectors, new, "m", 8, "v2").where("profile_version = 'v2'").count() == 0
