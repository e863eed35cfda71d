"""Operators that SQL can't express, against plain Python, and the hand-made cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelsift.functions import columns as X
from reelsift.operators import catalog, clips, evaluate, explain, feedback, lab, quality, rerank, review
from reelsift.operators.feedback import comparisons, corrections
from reelsift.operators.greedy import independent
from reelsift.sources import files
from reelsift.plans import tables
from reelsift.streaming import jobs


def greedy(ids, near):
    kept = []
    for i in ids:
        if not any(near(i, k) for k in kept):
            kept.append(i)
    return set(kept)


def test_independent_set_equals_the_pass_in_order(spark):
    r = random.Random(2)
    edges = {(b, a) for a, b in ((r.randrange(80), r.randrange(80)) for _ in range(150)) if a < b} | {(i + 1, i) for i in range(100, 110)}
    ids = [*range(80), *range(100, 111)]
    got = independent(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(list(edges), "id long, other long")).collect()
    assert {x.id for x in got} == greedy(ids, lambda i, k: (i, k) in edges)


def merge(frames, gap, threshold, longest, peak):
    out, group = [], []

    def flush():
        if group:
            best = max(group, key=lambda f: (f[1], -f[0]))
            out.append((best[0], best[0], 1, best[1]) if len(group) > 1 and best[1] < peak else (group[0][0], group[-1][0], len(group), best[1]))
            group.clear()

    for ts, score in frames:
        if group and (ts - group[-1][0] > gap or group[-1][1] < threshold or score < threshold or (longest > 0 and ts - group[0][0] > longest)):
            flush()
        group.append((ts, score))
    flush()
    return sorted(out)


def test_clip_merge(spark):
    r = random.Random(3)
    cases = [([(5.0 * i, 0.55) for i in range(20)], (15, 0.3, 24, 0)), ([(t, 0.7) for t in (0.0, 5.0, 40.0, 45.0)], (15, 0.3, 24, 0)), ([(0.0, 0.7), (1.0, 0.7), (2.0, 0.2), (3.0, 0.7)], (15, 0.3, 24, 0)), ([(0.0, 0.4), (1.0, 0.48), (2.0, 0.45)], (15, 0.3, 24, 0.55)), (sorted({(float(r.randrange(600)), r.random()) for _ in range(150)}), (7, 0.25, 12, 0.6))]
    for frames, args in cases:
        frames = sorted({t: s for t, s in frames}.items())
        df = spark.createDataFrame([(1, t, i, s) for i, (t, s) in enumerate(frames)], "video long, ts double, frame long, score double").repartition(3)
        got = sorted((x.start, x.end, x.frames, x.score) for x in clips.clips(df, *args).collect())
        assert got == merge(frames, *args)


def test_clip_merge_carries_over_batches_and_videos(spark):
    r = random.Random(8)
    rows = [(v, float(i), i, r.choice([0.2, 0.5, 0.9])) for v in range(4) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "video long, ts double, frame long, score double").repartition(3)
        got = sorted((x.video, x.start, x.end, x.frames, x.score) for x in clips.clips(df, 15, 0.1, 24, 0).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((v, *c) for v in range(4) for c in merge([(x[1], x[3]) for x in rows if x[0] == v], 15, 0.1, 24, 0))


def test_narrative_takes_the_best_free_candidate_of_each_beat(spark):
    r = random.Random(9)
    vec = lambda: [r.uniform(-1, 1) for _ in range(4)]
    rows = [(c, c * 100 + i, r.randrange(3), r.random(), r.choice([0.0, 0.5, 1.0]), vec()) for c, n in ((0, 40), (1, 2), (2, 5)) for i in range(n)]
    beats = [(c, b, vec()) for c in (0, 1, 3) for b in range(4)]
    got = review.narrative(
        spark.createDataFrame(rows, "collection long, id long, source long, quality double, preference double, vector array<double>").repartition(3),
        spark.createDataFrame(beats, "collection long, beat long, vector array<double>"),
    ).collect()

    def scaled(xs, x):
        return 0.5 if max(xs) == min(xs) else (x - min(xs)) / (max(xs) - min(xs))

    def fit(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    want, used, seen = {}, set(), set()
    for c, b, v in beats:
        all_ = [x for x in rows if x[0] == c]
        total = lambda x: 0.4 * fit(x[5], v) + 0.3 * scaled([y[3] for y in all_], x[3]) + 0.2 * scaled([y[4] for y in all_], x[4]) + (0 if (c, x[2]) in seen else 0.01)  # noqa: E731, B023
        best = max((x for x in all_ if x[1] not in used), key=total, default=None)
        want[c, b] = best and best[1]
        if best:
            used.add(best[1]), seen.add((c, best[2]))
    assert {(x.collection, x.beat): x.id for x in got} == want
    assert all((x.id is None) == (x.missing is not None) for x in got)


def test_temporal_dedup(spark):
    r = random.Random(4)
    rows = [(i, i % 3, float(r.randrange(300)), r.choice([0.1, 0.5, 0.9])) for i in range(120)]
    got = {x.id for x in clips.temporal_dedup(spark.createDataFrame(rows, "id long, video long, peak double, score double"), 12.0).collect()}
    order = sorted(rows, key=lambda x: (-x[3], x[0]))
    by = {x[0]: x for x in rows}
    assert got == greedy([x[0] for x in order], lambda i, k: by[i][1] == by[k][1] and abs(by[i][2] - by[k][2]) <= 12)


def test_hamming_pairs_and_leaders(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(30)]
    bits = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 6))) for b in base for _ in range(5)] + base[:5]
    df = spark.createDataFrame([(i, b - 2**64 if b >> 63 else b) for i, b in enumerate(bits)], "id long, bits long")
    first = {b: i for i, b in reversed(list(enumerate(bits)))}
    ids = sorted(first.values())
    near = lambda i, k: (bits[i] ^ bits[k]).bit_count() <= 5
    assert {(p.a, p.b) for p in catalog.hamming_pairs(df).collect()} == {(a, b) for a in ids for b in ids if a < b and near(a, b)}
    lead = greedy(ids, near)
    want = {i: min(k for k in lead if near(i, k)) if i not in lead else i for i in range(len(bits))}
    assert {x.id: x.leader for x in catalog.leaders(df).collect()} == {i: want[first[b]] for i, b in enumerate(bits)}


def test_greedy_near_keeps_rows_without_vectors(spark):
    rows = [(1, 0, 0.9, [1.0, 0.0]), (2, 0, 0.8, [0.99, 0.1]), (3, 0, 0.7, None), (4, 1, 0.1, [1.0, 0.0])]
    got = review.greedy_near(spark.createDataFrame(rows, "id long, grp long, score double, vector array<double>"), 0.95).collect()
    assert {x.id for x in got} == {1, 3, 4}


def test_calibrator_is_a_monotone_step_function(spark):
    pairs = [(0.1, 1), (0.2, 0), (0.3, 0), (0.5, 1), (0.5, 0), (0.9, 1)]
    rows = spark.createDataFrame(pairs, "score double, label int")
    steps = sorted((s.edge, round(s.value, 6)) for s in evaluate.calibrator(rows).collect())
    assert steps == [(0.3, round(1 / 3, 6)), (0.5, 0.5), (0.9, 1.0)]
    got = evaluate.calibrated(spark.createDataFrame([(0.0,), (0.3,), (0.31,), (2.0,)], "score double"), evaluate.calibrator(rows)).collect()
    assert [round(x.probability, 6) for x in sorted(got)] == [0.333333, 0.333333, 0.5, 1.0]


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first().x
    assert [val(X.worthiness(F.lit(v))) for v in ("0.4", "7", "Excellent!", "so bad", "??", None)] == [0.4, 1.0, 0.9, 0.15, 0.5, 0.5]
    assert [val(X.canonical_emotion(F.lit(v))) for v in ("Joy", "boredom | Dread", "x", None)] == ["joy", "dread", "other", "other"]
    assert val(X.placeholders(F.lit("  "))) == ["empty"] and val(X.placeholders(F.lit("Describe what you actually SEE"))) == ["describe what you actually see"]
    assert tuple(val(X.clip_interval(F.lit("a@@@001_1500ms-2000ms.gif")))) == (1.5, 2.0) and tuple(val(X.clip_interval(F.lit("x.gif")))) == (0.0, 0.0)
    assert val(X.film_name(F.lit("/m/Heat-01.mp4"))) == "Heat" and val(X.film_name(F.lit("/m/12-a.mp4"))) == "12-a" and val(X.film_name(F.lit("_abc_def.gif"))) == "_abc"
    assert val(X.hamming(X.hash_bits(F.lit("f" * 16)), X.hash_bits(F.lit("0" * 16)))) == 64 and val(X.hamming(X.hash_bits(F.lit("no")), F.lit(1).cast("long"))) == 64
    for raw in ('<think>x</think>```json\n{"a": 1}\n```', 'sure: {"a": 1} bye', "none"):
        got = val(X.strict_json(F.lit(raw), "a int"))
        assert (got.a if got else None) == (None if raw == "none" else 1)


def test_gates(spark):
    rows = [(1, "A calm lake at dawn", "awe", ["soft light here", "still water now"], "because it is quiet", 0.5), (2, "one word", "joy|dread", None, "x", 3.0)]
    got = {x.id: x for x in quality.frame_gate(spark.createDataFrame(rows, "id long, caption string, emotion string, notes array<string>, why string, worth double")).collect()}
    assert got[1].status == "passed" and got[2].status == "quality_failed" and "several emotions" in got[2].errors
    raw = [("s", '{"schema_version": 1, "stage": "s", "clip_count": 1, "clips": [{"clip_id": "a"}]}'), ("s", '{"schema_version": 2, "stage": "t", "clip_count": 3, "clips": [{"clip_id": "a"}, {"clip_id": "a"}]}'), ("s", "no")]
    errors = [x.errors for x in quality.manifest_gate(spark.createDataFrame(raw, "stage string, raw string"), "schema_version int, stage string, clip_count int, clips array<struct<clip_id: string>>").collect()]
    assert errors == ["", "version; stage; count; repeated id", "unreadable"]


def test_corrections_and_comparisons(spark):
    events = spark.createDataFrame([(1, 7, 3, None), (2, 8, 3, 1)], "event_id long, target_id long, source long, supersedes_event_id long")
    new, refused = corrections(events, spark.createDataFrame([(2, "like", "n", 1), (2, "skip", "n", 2), (1, "like", "n", 1), (9, "like", "n", 1)], "event_id long, rating string, note string, created_at long"))
    assert [(x.target_id, x.rating, x.supersedes_event_id) for x in new.collect()] == [(8, "like", 2)]
    assert {(x.event_id, x.reason) for x in refused.collect()} == {(2, "repeated"), (1, "superseded"), (9, "unknown")}
    assert comparisons(spark.createDataFrame([(1, 5, 6)], "pair_id long, winner long, loser long")).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/Heat@@@001_1000ms-2500ms.gif").write_bytes(b"x" * 10)
    (tmp_path / "a.MP4").write_bytes(b"y" * 3000)
    (tmp_path / "b.txt").write_bytes(b"z")
    media = files.scan_media(spark, str(tmp_path), block=1000)
    assert {x.media_type for x in media.collect()} == {"gif", "video"}
    got = files.folder_candidates(media, spark.createDataFrame([], "path string")).first()
    assert (got.source, got.start, got.end) == ("Heat", 1.0, 2.5)
    new, clash = files.append_new(spark.createDataFrame([(1, "a")], "id long, v string"), spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c")], "id long, v string"), "id", ["id", "v"])
    assert [tuple(x) for x in new.collect()] == [(2, "c")] and [tuple(x) for x in clash.collect()] == [(1, "b")]
    out, known = f"file://{tmp_path}/out", spark.createDataFrame([(5, "x")], "id long, name string")
    shape = "collection long, version long, rank long, id long"
    for rows in ([(1, 1, 1, 5), (1, 1, 2, 6), (1, 0, 1, 5)], [(2, 4, 1, 6)]):
        made = [tuple(x) for x in files.export_collections(spark.createDataFrame(rows, shape), known, out).collect()]
    assert made == [(2, 4, 0, 1)]
    read = lambda name: sorted(tuple(x) for x in spark.read.json(f"{out}/{name}").select("collection", "version", "id").collect())
    assert (read("items"), read("missing")) == ([(1, 1, 5)], [(1, 1, 6), (2, 4, 6)])


def test_streams_equal_batches(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id as id", "text")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    jobs.index_postings(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    from reelsift.operators.search import postings

    assert spark.read.parquet(f"{tmp_path}/out").select("term", "id", "tf").exceptAll(postings(docs).select("term", "id", "tf")).isEmpty()
    made = jobs.embed(docs, lambda ts: [[1.0, 2.0] if t else [1.0] for t in ts], 2).groupBy("reason").count().collect()
    assert sum(x["count"] for x in made) == docs.count()


def test_taste_map_is_the_projection_on_two_axes(spark):
    r = np.random.default_rng(7)
    v = r.standard_normal((40, 5)) * [5, 3, 1, 1, 1] + 2
    got = {x.id: (x.x, x.y) for x in explain.taste_map(spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "id long, vector array<double>")).collect()}
    c = v - v.mean(0)
    want = c @ np.linalg.svd(c)[2][:2].T
    want *= np.sign(want[np.abs(want).argmax(0), [0, 1]])
    assert np.allclose([got[i] for i in range(40)], want)
    one = explain.taste_map(spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id long, vector array<double>")).collect()
    assert [tuple(x) for x in one] == [(1, 0.0, 0.0)]


def test_undo_of_nothing(spark, sf):
    assert feedback.undo_last(tables.events(spark, sf).limit(0)).isEmpty()
    assert feedback.undo_last(tables.events(spark, sf)).count() == 1


@pytest.fixture
def rocksdb(spark):
    pytest.importorskip("google.protobuf")
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_latest_ratings_equal_the_batch(spark, sf, tmp_path, rocksdb):
    events = tables.events(spark, sf).withColumn("target_id", F.col("target_id") % 20)
    events.repartition(2).write.parquet(f"{tmp_path}/in")
    found = {}

    def take(batch, _):
        found.update((x.target_id, x.event_id) for x in batch.collect())

    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.latest_ratings(stream).writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    want = {x.target_id: x.event_id for x in feedback.latest(feedback.effective(events)).collect()}
    assert {k: v for k, v in found.items() if v is not None} == want


def test_online_clips_close_after_a_gap(spark, tmp_path, rocksdb):
    rows = [(v, 1000.0 + t, 0.1 * (t % 7)) for v in (1, 2) for t in (0, 5, 10, 60, 65, 200)]
    df = spark.createDataFrame(rows, "video long, ts double, score double").withColumn("event_time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    found = []
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    jobs.online_clips(stream).writeStream.foreachBatch(lambda b, _: found.extend(b.collect())).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert {(x.video, x.start, x.end, x.frames) for x in found} >= {(v, s, e, n) for v in (1, 2) for s, e, n in ((1000.0, 1010.0, 3), (1060.0, 1065.0, 2))}


def test_imports(spark):
    runs = spark.createDataFrame([("v", None, [(1.0, 2.0), (3.0, 4.0)])], "video string, sha256 string, top_clips array<struct<start: double, end: double>>")
    assert [(x.run_candidate_id, x.start) for x in files.run_candidates(runs).collect()] == [("adaptive-clip-0001", 1.0), ("adaptive-clip-0002", 3.0)]
    items = files.benchmark_items(spark.createDataFrame([(" /a/b.mp4 ", "fast| |dark ")], "source_path string, difficulty_tags string")).first()
    assert (items.source_path, items.difficulty_tags) == ("/a/b.mp4", ["fast", "dark"])
    last = files.last_judgments(spark.createDataFrame([("a", "like", 1), ("a", "skip", 2)], "candidate_id string, rating string, judged_at long"))
    assert [tuple(x) for x in last.collect()] == [("a", "skip")]


def test_promotion(spark):
    runs = spark.createDataFrame([(c, s, "completed") for c in "ab" for s in ("tune", "holdout")][:3], "config string, split string, status string")
    got = lab.promotion(spark.createDataFrame([("a",), ("b",)], "config string"), runs, spark.createDataFrame([("a",), ("b",)], "config string"), spark.createDataFrame([("b", 0.5)], "config string, value double"))
    assert {x.config: (x.reasons, x.promoted) for x in got.collect()} == {"a": ("", True), "b": ("no holdout run; exports incomplete", False)}


def test_broken_objects_are_passed_over(spark):
    raw = ['note {oops} {"k": 2} {"k": 3}', '<think>{"k": 9}</think> ```json\n{"k": 1}\n```', "} {", None, '{"a": {"k": 5}, "k": 6} tail', ""]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string").select("i", X.strict_json(F.col("raw"), "k int").k.alias("k")).collect()
    assert {r.i: r.k for r in got} == {0: 2, 1: 1, 2: None, 3: None, 4: 6, 5: None}


def test_missing_vectors_are_near_all(spark):
    rows = spark.createDataFrame([(1, 0.9, [1.0, 0.0]), (2, 0.8, None), (3, 0.7, [0.0, 1.0])], "id long, score double, vector array<double>")
    assert [r.id for r in review.farthest_first(rows, 3).orderBy("rank").collect()] == [1, 3, 2]


def test_diverse_frames_by_rounds(spark):
    import random

    from reelsift.operators import library

    r = random.Random(3)
    rows = [(v, f, r.random(), (1 << r.randrange(40)) ^ (r.choice([0, (1 << 50) - 1]))) for v in range(4) for f in range(30)]
    want = set()
    for v in range(4):
        chosen = []
        for _, f, _, b in sorted((x for x in rows if x[0] == v), key=lambda x: (-x[2], x[1])):
            if len(chosen) < 9 and all((b ^ c).bit_count() > 1 for _, c in chosen):
                chosen.append((f, b))
        want |= {(v, f, i + 1) for i, (f, _) in enumerate(chosen)}
    got = library.diverse_frames(spark.createDataFrame(rows, "video int, frame long, score double, bits long"), 1)
    assert {(x.video, x.frame, x["rank"]) for x in got.collect()} == want


def test_near_keepers_equal_a_plain_pass(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((20, 6))
    vectors = [None if i % 29 == 0 else [0.0] * 6 if i % 31 == 0 else list(map(float, base[i % 20] + r.standard_normal(6) * 0.3)) for i in range(400)]
    rows = [(i, i % 3 or None, float(r.integers(0, 20)), v) for i, v in enumerate(vectors)][:200]
    frame = spark.createDataFrame(rows, "id long, grp long, score double, vector array<double>")
    got = review.near_keepers(frame, 0.8, batch=8)
    want, kept = {}, {}
    for i, g, _, v in sorted(rows, key=lambda x: (-x[2], x[0])):
        want[i] = i
        if v is None:
            continue
        u = np.asarray(v) / (np.linalg.norm(v) or 1.0)
        near = next((k for k, w in kept.setdefault(g, []) if u @ w >= 0.8), None)
        if near is None:
            kept[g].append((i, u))
        want[i] = i if near is None else near
    assert {x.id: x.keeper for x in got.collect()} == want
    groups = {x.keeper: x.duplicates for x in review.duplicate_groups(got).collect()}
    assert sum(groups.values()) == sum(i != k for i, k in want.items()) > 0


def test_rerank_follows_what_is_available(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0], ["k"], 0.4), (2, None, None, 0.3)], "id long, vector array<double>, keys array<string>, base double")
    shape = "liked array<double>, disliked array<double>, confidence double"
    scenarios = spark.createDataFrame([("k", [1.0, 0.0])], "key string, centroid array<double>")
    run = lambda profile, **k: {x.id: (x.final_score, x.profile_score, x.reasons) for x in rerank.rerank(c, spark.createDataFrame(profile, shape), scenarios, **k).collect()}
    assert run([([1.0, 0.0], [0.0, 1.0], 1.0)])[1] == (round((0.55 * 0.4 + 0.25 + 0.15) / 0.95, 6), round((0.25 + 0.15 + 0.2 * 0.5) / 0.6, 6), "")
    assert run([(None, [1.0, 0.0], 1.0)])[1] == (round((0.55 * 0.4 + 0.15) / 0.7 - 0.2, 6), round(0.15 / 0.35, 6), "no liked centroid")
    assert run([])[1] == (0.4, None, "no profile; no scenario") and run([])[2] == (0.3, None, "no vector; no profile; no keys")
    assert run([([1.0, 0.0], None, 1.0)], enabled=False)[1] == (0.4, None, "disabled; no scenario")


def test_manifest_is_verified(spark, tmp_path):
    items = spark.createDataFrame([("a", "1"), ("b", None)], "fingerprint string, item string")
    made = files.write_manifest(items, f"file://{tmp_path}/m")
    assert files.freeze(items.orderBy(F.desc("fingerprint"))).first().manifest_id == made != files.freeze(items, 2).first().manifest_id
    assert files.read_manifest(spark, f"file://{tmp_path}/m").count() == 2
    spark.createDataFrame([("c", "3")], items.schema).write.mode("append").parquet(f"file://{tmp_path}/m/items")
    with pytest.raises(ValueError):
        files.read_manifest(spark, f"file://{tmp_path}/m")
    with pytest.raises(ValueError):
        files.write_manifest(items.union(items), f"file://{tmp_path}/n")


def test_judgments_and_items_are_read(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"candidate_id": "a", "rating": "like", "judged_at": "1"}\n\n{"candidate_id": "a", "rating": "skip", "judged_at": "2"}\n')
    assert [tuple(x) for x in files.read_judgments(spark, f"file://{tmp_path}/j.jsonl").collect()] == [("a", "skip")]
    (tmp_path / "i.csv").write_text("source_path,difficulty_tags,video_fingerprint\n /x/a.b.mp4 ,dark| |fast, f1 \n/x/.hidden,,f2\n")
    got = {x.item_id: (x.source_path, x.video_fingerprint, x.pace_bucket, x.difficulty_tags) for x in files.read_benchmark(spark, f"file://{tmp_path}/i.csv").collect()}
    assert got == {"a.b": ("/x/a.b.mp4", "f1", None, ["dark", "fast"]), ".hidden": ("/x/.hidden", "f2", None, [])}


def test_backfill_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(i, "bad" if i == 3 else "short" if i == 4 else "t") for i in range(40)], "id long, text string")
    excluded, path = spark.createDataFrame([(7,)], "id long"), f"file://{tmp_path}/v"

    def down(texts):
        raise jobs.ServiceUnavailable("off")

    def up(texts):
        if "bad" in texts:
            raise ValueError("bad text")
        return [[1.0] if x == "short" else [1.0, 2.0] for x in texts]

    with pytest.raises(Exception, match="off"):
        jobs.backfill(rows, excluded, path, down, 2)
    for _ in range(2):
        made = {x.id: x.reason for x in jobs.backfill(rows, excluded, path, up, 2, parts=3).collect()}
        assert len(made) == 39 and {i: m for i, m in made.items() if m} == {3: "embedding failed: bad text", 4: "dimension"}
