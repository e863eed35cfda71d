"""The pipeline's near-duplicate stage against all pairs."""

import random
import re

from pyspark.sql import functions as F

from reelsift.llm import near_copies

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def firsts(rows):
    p, sets = list(range(len(rows))), [shingles(t) for _, t in rows]

    def f(x):
        while p[x] != x:
            x = p[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both >= 0.8 * either:
                x, y = sorted((f(a), f(b)))
                p[y] = x
    return {rows[i][0] for i in range(len(rows)) if f(i) == i}


def test_near_copies_of_short_and_medium_texts_go(spark):
    import corpus_pipeline

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, n = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  TWO"), (5, "one two three")], 6
    for size in (30, 60, 100, 100, 300, 800):
        base = [word() for _ in range(size)]
        for k in range(25):
            text = base.copy()
            for _ in range(k % 7):
                text[r.randrange(size)] = word()
            rows.append((n, " ".join(text)))
            n += 1
    docs = spark.createDataFrame([(i, t, "x") for i, t in [*rows, (None, rows[10][1])]], "doc_id long, text string, lang string").repartition(3)
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert left.columns == docs.columns
    got = [x.doc_id for x in left.collect()]
    assert None in got
    assert {x for x in got if x is not None} == firsts(rows)
    for block in (300, 3000):
        assert {x.doc_id for x in near_copies.dedup(docs.where(F.col("doc_id").isNotNull()), block=block).collect()} == firsts(rows)
    assert near_copies.dedup(docs.limit(0)).count() == 0


def test_pairs_of_simhash_link_without_a_shared_cell(spark, monkeypatch):
    """Minimum hashes miss a pair now and then; here they miss all."""
    r = random.Random(4)
    base = [f"w{r.randrange(10_000)}" for _ in range(2000)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "end"])), (3, " ".join([*base[:1000], "mid", *base[1000:]])), (4, "something else"), (5, " ".join(base[1000:] + base[:1000]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert firsts(rows) == {1, 4}
    cells = near_copies._cells

    def apart(size):
        def run(batches):
            import pyarrow as pa

            for batch in cells(size)(batches):
                own = [[k] for k in batch.column("doc_id").to_pylist()]
                yield batch.set_column(4, "cells", pa.array(own, pa.list_(pa.int64())))

        return run

    monkeypatch.setattr(near_copies, "_cells", apart)
    assert {x.doc_id for x in near_copies.dedup(docs).collect()} == {1, 4}
