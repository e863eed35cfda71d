"""Proposals of moved files: whole and right on odd rows, and their pairs are not shuffled."""

import random

from reelsift.operators import catalog

CATALOG, SCANNED = "id long, path string, sha256 string, fingerprint string", "path string, sha256 string, fingerprint string"


def plain(known, scanned):
    pairs = [(i, p, q, h == g, f is not None and f == e) for i, p, h, f in known for q, g, e in scanned if None not in (p, q, h, g) and p != q]
    rows = [(i, p, q, "exact") for i, p, q, same, _ in pairs if same]
    found = {r[0] for r in rows}
    rows += [(i, p, q, "probable") for i, p, q, same, like in pairs if like and not same and i not in found]
    paths = [r[2] for r in rows]
    return sorted((i, p, q, "conflict" if paths.count(q) > 1 else kind) for i, p, q, kind in rows)


def test_proposals_of_odd_rows(spark):
    seen = set()
    for seed in range(4):
        rng = random.Random(seed)
        pick = lambda head, n: rng.choice([None] + [f"{head}{i}" for i in range(n)])  # noqa: E731, B023
        # Ids and paths that repeat, paths on both sides, nulls, and one frequent fingerprint.
        known = [(rng.randrange(50), pick("p", 30), pick("h", 25), rng.choice(["often", pick("f", 40)])) for _ in range(60)]
        scanned = [(pick("p", 40 if seed < 2 else 400), pick("h", 30 if seed % 2 else 300), pick("f", 40) if seed else "often") for _ in range(40)]
        got = catalog.relinks(spark.createDataFrame(known, CATALOG), spark.createDataFrame(scanned, SCANNED), block=3).select("id", "old_path", "new_path", "kind").collect()
        assert sorted(map(tuple, got)) == plain(known, scanned)
        seen |= {r.kind for r in got}
    assert seen == {"exact", "probable", "conflict"}


def test_pairs_are_not_shuffled(spark):
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()
    shuffled = lambda: sum(s.shuffleWriteRecords() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)))
    n = 300
    known = spark.range(n).selectExpr("id", "concat('/old/', id) AS path", "concat('a', id) AS sha256", "'often' AS fingerprint")
    scanned = spark.range(n).selectExpr("concat('/new/', id) AS path", "concat('b', id) AS sha256", "'often' AS fingerprint")
    before = shuffled()
    rows = catalog.relinks(known, scanned).collect()
    assert len(rows) == n * n and {r.kind for r in rows} == {"conflict"}
    assert shuffled() - before <= 20 * n
