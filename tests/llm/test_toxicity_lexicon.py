"""Every gram that passes the evidence test votes, and the sparse label model is the dense one."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from reelsift.llm import toxicity


def test_more_than_500_marker_grams_all_vote(spark):
    r = random.Random(9)
    clean = ["".join(r.choice("abcdef") for _ in range(6)) for _ in range(200)]
    marks = ["".join(r.choice("uvwxyz") for _ in range(9)) for _ in range(150)]
    rows, labels = [], []
    for i in range(9000):
        words = [r.choice(clean) for _ in range(12)]
        if i % 5 == 0:
            words[3] = marks[(i // 5) % 150]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    tests = [(10_000 + k, " ".join([*clean[:11], m])) for k, m in enumerate(marks)]
    docs = spark.createDataFrame([*rows, *tests], "doc_id long, text string").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, known).where("doc_id >= 10000").collect()
    assert len(toxicity.fit(docs, known).lexicon) > 500
    # A marker in fewer than 8 of the documents fitted on (those outside the held-out fold) has too little evidence.
    seen = Counter((i // 5) % 150 for i in range(0, 9000, 5) if zlib.crc32(str(i).encode()) % 5)
    assert {x.doc_id - 10_000 for x in got if x.predicted} >= {k for k in seen if seen[k] >= 8}


def test_sparse_label_model_is_the_dense_one():
    r = np.random.default_rng(3)
    x = r.random((300, 40)) < np.linspace(0.02, 0.6, 40)
    x[:, 7], x[:, 9] = x[:, 8], ~x[:, 10]
    labels = (x[:, :5].any(1) ^ (r.random(300) < 0.05)).astype(int)
    p = np.where(labels == 1, 0.98, 0.02)
    said = np.where(labels == 1, 1, -1) * np.log(0.98 / 0.02)
    for _ in range(10):
        prior, yes, no = (p.sum() + 1) / 302, (p @ x + 0.1) / (p.sum() + 1), ((1 - p) @ x + 0.1) / ((1 - p).sum() + 1)
        rest = x - np.outer(p, yes) - np.outer(1 - p, no)
        scale = np.sqrt((rest * rest).sum(0)) + 1e-6
        related = np.abs(rest.T @ rest) / np.outer(scale, scale)
        related[related < 0.5] = 0
        np.fill_diagonal(related, 1)
        p = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + said + x @ ((np.log(yes) - np.log(no)) / related.sum(1)), -30, 30)))
    model = toxicity.LabelModel(*np.nonzero(x), 40, labels)
    assert model.posterior == pytest.approx(p, abs=1e-6)
    assert model.share == pytest.approx(1 / related.sum(1), abs=1e-6)


def test_grams_of_a_batch_are_counted_in_slices():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from reelsift.llm import kernels as K
    from reelsift.llm import toxicity

    texts = [" ".join(f"word{(i * 31 + k * k) % 997}" for k in range(300)) for i in range(1500)] + [None, "", "x" * 300_000]
    marks = [i % 3 == 0 for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(marks).cast(pa.int32()), pa.array(texts)], names=["toxic", "text"])
    gram, text = toxicity.grams(*K.flat(batch.column("text")))
    pairs = np.unique(np.stack([gram.view(np.int64), text]), axis=1)
    want = {}
    for g, i in pairs.T.tolist():
        k, n = want.get(g, (0, 0))
        want[g] = (k + marks[i], n + 1)
    tracemalloc.start()
    got = list(toxicity._mine(iter([batch, batch.slice(0, 0)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 1 and {g: (k, n) for g, k, n in zip(*(c.to_pylist() for c in got[0].columns))} == want
    assert peak < 100e6, peak
